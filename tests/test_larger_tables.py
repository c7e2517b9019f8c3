"""Queries on tables larger than those given: high keys, many and large groups."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from caseweave import packs
from caseweave.functions.text import SPACE, SPACES
from caseweave.operators import reports, rules, tables, texts, vector
from caseweave.plans import registry
from caseweave.plans.streams import rocks
from caseweave.streaming import gates, limits

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_formats_with_keys_of_large_tables(spark, tmp_path):
    """The square of a key is soon more seconds than a timestamp holds."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(40)
    orders.withColumn("o_orderkey", F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 900_000).otherwise(54_000_000)).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    found = con.execute(registry.ORACLE_SQL["formats"])
    names = [d[0] for d in found.description]
    want = sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in found.fetchall())
    assert rows_of(registry.QUERIES["formats"](spark, str(tmp_path))) == want


def test_rows_that_lose_keys_are_dealt_by_their_number(spark, monkeypatch):
    """A task sorts a bounded number of rows, however few bytes they take in the shuffle."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, key in (("cascade_remaining", "case_id"), ("docs_without_events", "document_id")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = registry.QUERIES[name](spark, SF)
            dealt = re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        rows = con.execute("SELECT count(*) FROM lineitem" + " WHERE l_linestatus = 'F' AND l_returnflag <> 'A'" * (key == "document_id")).fetchone()[0]
        assert dealt and min(map(int, dealt)) >= rows / 100 > 4
        want = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert rows_of(found) == sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in want.fetchall())


def held_rows(spark, tmp_path, found, given):
    """The rows of state after one batch of `given`, and what came out."""
    given.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with rocks(spark):
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return sum(x["numRowsTotal"] for x in q.lastProgress["stateOperators"]), spark.read.schema(found.schema).parquet(str(tmp_path / "out"))


def test_sliding_state_is_a_value_and_a_timer_for_many_requests(spark, tmp_path):
    given = spark.range(400).select(F.lit(7).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 10 + 1_700_000_000).alias("ts"))
    given.limit(0).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = limits.sliding_stream(spark.readStream.schema(given.schema).parquet(str(tmp_path / "in")), 6000, 3)
    n, out = held_rows(spark, tmp_path, found, given)
    assert n <= 3
    last = given.agg(F.max("ts")).first()[0].timestamp() - 60
    assert rows_of(out) == [r for r in rows_of(limits.sliding(given, 6000, 3)) if r[2].timestamp() < last]


def test_gate_state_is_a_value_and_a_timer_for_many_requests(spark, tmp_path):
    given = spark.range(400).select(F.lit(7).cast("long").alias("case_id"), F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("at"), (F.col("id") % 50 == 49).alias("answer"))
    given.limit(0).coalesce(1).write.parquet(str(tmp_path / "in"))
    split = lambda d: (d.where("NOT answer").select("case_id", F.col("at").alias("requested")), d.where("answer").select("case_id", F.col("at").alias("confirmed")))
    n, out = held_rows(spark, tmp_path, gates.gate_stream(*split(spark.readStream.schema(given.schema).parquet(str(tmp_path / "in")))), given)
    assert n <= 3
    last = given.agg(F.max("at")).first()[0].timestamp() - 86400
    assert rows_of(out) == [r for r in rows_of(gates.gate(*split(given))) if r[1] and r[1].timestamp() < last]


def vectors(spark, n, size=8):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(k, rng.normal(size=size).round(2).tolist()) for k in range(n)], "id long, v array<double>")


def asked(rows, every):
    return rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("v").alias("vector"))


def test_approximate_search_joins_no_pairs(spark):
    """Pairs that share a bucket are most of all pairs, so they must not pass a shuffle."""
    rows = vectors(spark, 600)
    found = reports.approximate_nearest(rows, asked(rows, 20), "id", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    exact = {(r["query"], r["id"]): r["rank"] for r in vector.nearest(rows, asked(rows, 20), "id", "v", 0.3038).collect()}
    got = {(r["query"], r["id"]) for r in found.collect()}
    assert len(got & set(exact)) >= 0.9 * len(exact) and len(got) == len({(q, k) for q, k in got})


def test_exact_search_holds_few_products_at_a_time(spark, monkeypatch):
    """Rows at a time fall as queries rise; what is over the best so far alone is kept."""
    rows = vectors(spark, 500).repartition(2)
    want = rows_of(vector.nearest(rows, asked(rows, 5), "id", "v"))
    monkeypatch.setattr(vector, "CELLS", 700)
    assert rows_of(vector.nearest(rows, asked(rows, 5), "id", "v")) == want and len(want) == 500


def test_best_sorts_out_and_tells_what_is_needed():
    best, rng = vector.Best(3, 50), np.random.default_rng(1)
    parts = [(rng.integers(0, 9, 40), np.arange(40 * k, 40 * k + 40), rng.random(40).round(1)) for k in range(9)]
    seen = []
    for q, k, s in parts:
        seen += zip(q.tolist(), (-s).tolist(), k.tolist(), strict=True)
        if best.add(q, k, s):
            for x, floor in enumerate(best.floors(np.arange(9)).tolist()):
                mine = sorted(r[1:] for r in seen if r[0] == x)
                assert floor == (-mine[2][0] if len(mine) >= 3 else -np.inf)
    want = [r for x in range(9) for r in sorted(r for r in seen if r[0] == x)[:3]]
    assert [(q, -s, k) for q, k, s in zip(*(c.tolist() for c in best.rows()), strict=True)] == want


def test_cuts_in_a_text_at_hand_are_those_of_columns(spark):
    """Long texts with few and many line feeds, among them characters of two and four bytes."""
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(list("abà 😀\n"), 4000, p=[0.4, 0.3, 0.1, 0.1 - p, 0.1, p])) for p in (0.0, 0.002, 0.02, 0.09)] + ["x" * 1500, "x" * 1501, "", "ab\n\n" * 700]
    rows = spark.createDataFrame([(t,) for t in made], "t string").select("t", texts.cut_points(F.col("t"), 1500, 200, 300).alias("c"))
    assert [[tuple(c) for c in r.c] for r in rows.collect()] == [texts.cuts(t, 1500, 200, 300) for t in made]


def test_chunks_count_no_characters_from_the_start_of_a_text(spark):
    """A fold over columns reads a text again for every cut: quadratic in its length."""
    plan = registry.QUERIES["text_chunks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "MapInArrow" in plan
    assert spark.range(1).where(F.regexp_replace(F.lit(SPACES), SPACE, "") == "").count() == 1 and len(set(SPACES)) == 25


def test_word_vectors_are_sums_of_hashed_words():
    import hashlib

    want = np.zeros((3, 64))
    for k, t in enumerate(made := ["uno due due", "", "Tre uno"]):
        for w in t.lower().split():
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            want[k, int.from_bytes(d[:4], "little") % 64] += 1 if d[4] & 1 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert (reports.hash_vectors(made) == want).all()


def test_texts_are_derived_once_for_all_their_quotes(spark):
    """Not once for each quote, nor as lists of words: as many rows as texts meet the quotes, and texts go to Python as they are."""
    docs = spark.createDataFrame([(1, "Prima riga, poi  la SECONDA riga del testo [PAGE_START:1] e altro ancora qui"), (2, None), (3, "corto")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 0, "Prima riga"), (1, 1, "la seconda  riga del"), (1, 2, "manca del tutto in questo testo"), (1, 3, ""), (1, 4, "Prima riga poi SECONDA riga del testo"), (2, 0, "niente che si trovi"), (3, 0, None)], "doc_id long, quote_id int, quote string")
    found = texts.provenance(quotes, docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "array<string>" not in plan
    assert rows_of(found) == [(1, "exact", 0), (1, "lcs", 4), (1, "normalized", 1), (1, "unverified", 2), (1, "unverified", 3), (2, "unverified", 0), (3, "unverified", 0)]
    assert {(r.doc_id, r.quote_id, r.start, r.end) for r in texts.located(quotes, docs).collect()} == {(1, 0, 0, 10), (1, 1, 16, 35)}


def test_stems_leave_no_clinical_value_out(spark, monkeypatch):
    """Every alternative of every pattern, in any case; and texts without any are not matched with patterns."""
    heads = "PA pressione Press.Art. press art sistolica fc Freq.Card. freq card frequenzacardiaca battiti SpO2 sao2 saturazione sat.o2 Sat O2 glicemia GLUCOSIO glyc inr hb Emoglobina hgb temperatura temp. TC t.corp. T\u00a0corp creatinina creat. nulla".replace("press art", "press_art").replace("freq card", "freq_card").replace("Sat O2", "Sat_O2").split(" ")
    made = [(1, k, f"x {h.replace('_', ' ')}: {v} y") for k, (h, v) in enumerate((h, v) for h in heads for v in ("30/20", "290/150", "300", "20", "55,5", "99.9", "0,1"))]
    t = spark.createDataFrame(made, "case_id long, order_number int, title string").withColumns({"description": F.lit("fine"), "event_date": F.lit("2020-01-01").cast("date") + F.col("order_number")})
    got = rows_of(rules.clinical_values(t))
    assert set(packs.CLINICAL_STEMS) == {c[0] for c in packs.CLINICAL} == {r[2] for r in got}
    monkeypatch.setattr(packs, "CLINICAL_STEMS", {})
    assert rows_of(rules.clinical_values(t)) == got and len(got) > 50


def test_personal_data_is_detected_once(spark):
    """Both for the pseudonyms and for the masked texts."""
    plan = registry.QUERIES["pii_mask"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """However few buckets there are, a task writes about as much as Spark advises."""
    from caseweave.sources.versions import VersionedTable

    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    before = [spark.conf.get(n) for n in names]
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k", 1)
    try:
        for n in names:
            spark.conf.set(n, "64k")
        table.create(spark.range(0, 100_000, 1, 8).select(F.col("id").alias("k"), F.xxhash64("id").alias("v")))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert len(list(tmp_path.glob("t/data/*/_bucket=0/*.parquet"))) > 1 and table.read().count() == 100_000
