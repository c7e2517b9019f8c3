"""Array functions against plain loops; texts of very many finds and lines in about linear time."""

import random
import re
import time

from pyspark.sql import functions as F

from caseweave.functions.arrays import has_repeated, sums_before
from caseweave.operators import pii, texts
from caseweave.sources.files import subject_access


def test_sums_and_repeats(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(50) for _ in range(n)]) for k, n in enumerate([0, 1, 3, 63, 64, 65, 128, 1000])]
    df = spark.createDataFrame(rows, "id int, v array<int>")
    got = {r.id: (r.s, r.r) for r in df.select("id", sums_before(F.col("v")).alias("s"), has_repeated(F.col("v"), 4).alias("r")).collect()}
    for k, v in rows:
        assert got[k] == ([sum(v[:j]) for j in range(len(v))], any(v.count(x) >= 4 for x in v))


def test_very_many_finds(spark):
    parts = [f"il {k % 28 + 1}/{k % 12 + 1}/2024 telefono 333 123 {k % 10000:04d} a{k}@b.it " for k in range(6000)]
    df = spark.createDataFrame([(1, "".join(parts)), (2, None)], "doc_id long, text string")
    start = time.time()
    found = pii.detected(df)
    r = {x.doc_id: x for x in found.select("doc_id", "kept", "text").collect()}
    assert time.time() - start < 60
    assert len(r[1].kept) == 18000 and len(r[2].kept) == 0
    assert all(r[1].text[x.start : x.end] == x.found for x in r[1].kept)
    masked = {x.doc_id: x for x in pii.masked(found.where("doc_id = 2").unionByName(pii.detected(df.withColumn("text", F.substring("text", 1, 4000)).where("doc_id = 1")))).collect()}
    assert masked[2].masked == "" and not re.search(r"\d{4}", masked[1].masked[:3000].replace("_", " ")) and masked[1].replaced > 100


def test_very_many_lines_without_a_blank_one(spark):
    lines = "\n".join(f"voce {k} di {'x' * (k % 97)} y{k}" for k in range(8000))
    start = time.time()
    assert [r[0] for r in spark.createDataFrame([(lines,), ("a\nb 1\nc",)], "t string").select(texts.is_table(F.col("t"))).collect()] == [True, False]
    assert time.time() - start < 60


def test_audit_rows_are_cut_to_the_last_before_they_are_gathered(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, name string")
    audit = spark.createDataFrame([(1, k, f"r{k}") for k in range(30)], "user_id long, at long, what string")
    got = subject_access(users, {"cases": audit.where("at < 2"), "audit": audit}, most_audit=3)
    found = {r.user_id: r.json for r in got.collect()}
    assert found[1] == '{"profile":{"name":"a"},"cases":[{"what":"r1"},{"what":"r0"}],"audit":[{"what":"r29"},{"what":"r28"},{"what":"r27"}]}'
    assert found[2] == '{"profile":{"name":"b"},"cases":[],"audit":[]}'
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
