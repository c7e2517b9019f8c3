"""Operators on small inputs with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from caseweave.functions import dates, text
from caseweave.operators import intervals, links, periods, pii, quantify, rules, texts, timeline
from caseweave.packs import EVENT_TYPES

DAY = datetime.date.fromisoformat


def case(spark, *events):
    """A timeline of one case from (date, type, title, description)."""
    rows = [(1, k, k % 2, DAY(d), t, EVENT_TYPES.index(t), title, note, None, "ortopedica") for k, (d, t, title, note) in enumerate(events)]
    schema = "case_id long, event_id long, document_id long, event_date date, event_type string, type_rank int, title string, description string, diagnosis string, case_type string"
    return timeline.numbered(spark.createDataFrame(rows, schema))


def column(spark, expression, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expression.alias("x")).first()["x"]


def test_periods_of_a_known_case(spark):
    t = case(spark, ("2024-01-10", "ricovero", "Ricovero", ""), ("2024-01-18", "referto", "Lettera di dimissione", ""), ("2024-02-20", "intervento", "A", ""), ("2024-04-25", "intervento", "B", ""), ("2024-06-15", "follow-up", "Controllo", ""))
    found = {(r.label, r.days) for r in periods.all_periods(t).collect()}
    assert {("ricovero", 8), ("malattia", 157), ("interventi 1", 65), ("ITT", 8), ("ITP", 149)} == found


def test_undated_events_are_left_out_of_gaps(spark):
    t = case(spark, ("1900-01-01", "visita", "", ""), ("2020-01-01", "visita", "", ""), ("2021-06-01", "esame", "", ""), ("2021-06-02", "esame", "", ""), ("2021-06-03", "esame", "", ""))
    assert [(r.order_a, r.days, r.severity) for r in rules.documentation_gaps(t).collect()] == [(2, 517, "alta")]


def test_rules_do_not_depend_on_row_order(spark):
    events = [("2020-01-01", "visita", "v", "pa 215/130"), ("2020-08-01", "diagnosi", "d", ""), ("2020-08-20", "intervento", "i", ""), ("2021-03-01", "esame", "e", ""), ("2021-03-02", "terapia", "t", ""), ("2021-08-02", "altro", "x", "")]
    t = case(spark, *events)
    one = sorted(map(str, rules.anomalies(t).collect()))
    two = sorted(map(str, rules.anomalies(t.orderBy(F.rand(1)).repartition(3)).collect()))
    assert one == two
    assert {"ritardo_diagnostico", "gap_post_chirurgico", "consenso_non_documentato", "valore_clinico_critico", "gap_documentale", "sequenza_temporale_violata"} <= {r.split("anomaly_type='")[1].split("'")[0] for r in one}


def test_empty_timeline_has_no_findings(spark):
    assert rules.anomalies(case(spark, ("2020-01-01", "visita", "", "")).limit(0)).count() == 0


@pytest.mark.parametrize(("percent", "age", "want"), [(1, None, 947.30), (9, 50, 15687.29), (10, None, 22362.12), (101, 30, None), (0, 30, None), (10, 0, 22362.12)])
def test_damage_amounts(spark, percent, age, want):
    assert column(spark, quantify.damage_amount(F.col("p"), F.col("a").cast("int")), p=percent, a=age) == want


def test_interpolated_amounts_fall_with_age_and_grow_with_percentage(spark):
    rows = spark.range(10, 101).select(*(quantify.interpolated_amount(F.col("id"), F.lit(a))["amount"].alias(f"a{a}") for a in (1, 25, 60, 100))).collect()
    assert all(r[0] >= r[1] >= r[2] >= r[3] for r in rows)
    assert all(all(x < y for x, y in zip(a, b, strict=True)) for a, b in zip(rows, rows[1:]))


def test_combined_and_residual_percentages(spark):
    assert column(spark, quantify.combined(F.array(F.lit(20.0), F.lit(30.0)))) == 44.0
    assert column(spark, quantify.combined(F.array(F.lit(30.0), F.lit(20.0)))) == 44.0
    assert column(spark, quantify.combined(F.array().cast("array<double>"))) == 0.0
    assert column(spark, quantify.residual(F.lit(40), F.lit(20))) == 25.0
    assert column(spark, quantify.residual(F.lit(20), F.lit(40))) is None


def test_personal_data_is_masked_consistently(spark):
    note = "Dott. Mario Rossi visita Anna Bianchi, nata il 12/03/1980; tel. 0571 234567, mail a.b@c.it. Anna Bianchi torna il 3 marzo 2024 in Via Roma 12."
    found = pii.detected(spark.createDataFrame([(1, note), (2, ""), (3, None)], "doc_id long, text string"), names=["Anna Bianchi"])
    rows = {r.doc_id: r for r in pii.masked(found).collect()}
    assert rows[1].masked == "[PERSONA_2] visita [PERSONA_1], nata il [DATA_1]; tel. [TELEFONO_1], mail [EMAIL_1]. [PERSONA_1] torna il [DATA_2] in [INDIRIZZO_1]."
    assert rows[1].replaced == 8
    assert rows[2].masked == rows[3].masked == ""


def test_greedy_spans_keep_the_longer_of_equal_starts(spark):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 9), (0, 3), (0, 6), (6, 7), (9, 10))))
    assert [tuple(x) for x in column(spark, intervals.greedy(spans))] == [(0, 6), (6, 7), (9, 10)]


def test_merging_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (2, 1, 2), (1, 10, 11)], "doc_id long, start long, end long")
    once = intervals.merged(rows)
    assert sorted(map(tuple, once.collect())) == [(1, 0, 7), (1, 9, 12), (2, 1, 2)]
    assert sorted(map(tuple, intervals.merged(once).collect())) == sorted(map(tuple, once.collect()))


def test_chunks_overlap_and_carry_their_heading(spark):
    body = "\n".join("riga numero %04d" % k for k in range(200))
    docs = [(1, "# Titolo\n" + body), (2, None), (3, "breve"), (4, "prima parte senza titolo, abbastanza lunga\n## Altra\ncorta\n### Terza  \n" + "x" * 4000)]
    found = texts.chunks(spark.createDataFrame(docs, "id long, t string"), "id", "t").orderBy("id", "chunk").collect()
    one = [r.content for r in found if r.id == 1]
    assert len(one) > 2 and all(c.startswith("[Titolo]\n") and len(c) <= 1500 + len("[Titolo]\n") for c in one)
    assert set(body.split("\n")) <= {line for c in one for line in c.split("\n")}
    assert {r.id for r in found} == {1, 4}
    four = [(r.chunk, r.title, len(r.content)) for r in found if r.id == 4]
    assert four == [(0, None, 42), (1, "Terza", 1508), (2, "Terza", 1508), (3, "Terza", 1408)]
    assert [r.tokens for r in found if r.id == 4] == [11, 377, 377, 352]


def brute_windows(lengths, most, overlap=2):
    """Runs of pages (first, last) in their order; a longer page by itself."""
    out, held = [], []
    for k, n in enumerate(lengths):
        if n > most:
            out += [(held[0], held[-1])] if held else []
            out.append((k, k))
            held = []
            continue
        if held and sum(lengths[j] for j in held) + n > most:
            out.append((held[0], held[-1]))
            held = held[-overlap:]
        held.append(k)
    return out + ([(held[0], held[-1])] if held else [])


def test_page_windows_by_brute_force(spark):
    import random

    rng = random.Random(4)
    docs = {d: [rng.choice((10, 40, 90, 160, 1500)) for _ in range(rng.randint(1, 12))] for d in range(40)}
    rows = [(d, k, "a" * n) for d, ns in docs.items() for k, n in enumerate(ns)]
    found = texts.page_windows(spark.createDataFrame(rows, "document_id long, page_number int, ocr_text string"), most=200).collect()
    for d, ns in docs.items():
        got = sorted((r.chunk, r.first_page, r.last_page, r.start, r.stop) for r in found if r.document_id == d)
        runs = list(dict.fromkeys((a, b) for _, a, b, *_ in got))
        assert runs == brute_windows(ns, 200)
        assert all((s is None) == (ns[a] <= 200) for _, a, _, s, _ in got)
        for a, n in enumerate(ns):
            if n > 200:
                parts = [(s, e) for _, x, _, s, e in got if x == a and s is not None]
                assert parts[0][0] == 0 and parts[-1][1] == n and all(e - s <= 200 for s, e in parts)


def test_longest_common_subsequence_by_table():
    import random

    rng = random.Random(1)
    for _ in range(200):
        q, w = [[rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2)]
        best, size = 0.0, min(3 * len(q), len(w))
        for a in range(0, len(w) - size + 1, max(1, len(q) // 2)) if q and w else ():
            table = [[0] * (size + 1) for _ in range(len(q) + 1)]
            for i, x in enumerate(q):
                for j, y in enumerate(w[a : a + size]):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            best = max(best, table[-1][-1] / len(q))
            if best >= 0.8:
                break
        assert texts.window_ratio(q, w) == best


def test_approximate_search_finds_most_of_the_exact(spark):
    from caseweave.plans import registry

    sf = "/root/testdata/sf0.01"
    chunks = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = chunks.where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS vector")
    from caseweave.operators import vector

    exact = {(r.query, r.vec_id) for r in vector.nearest(chunks, queries, "vec_id", "embedding").collect()}
    blocked = {(r.query, r.vec_id) for r in vector.nearest(chunks, queries, "vec_id", "embedding", block=3).collect()}
    found = {(r.query, r.vec_id) for r in registry.QUERIES["vector_approximate"](spark, sf).collect()}
    assert exact == blocked and len(exact) > 10 and len(exact & found) >= 0.9 * len(exact)


def test_new_events_are_ordered_by_title_and_marked_before_known_ones_go(spark):
    import datetime

    from caseweave.operators.details import consolidated

    kind = "case_id long, event_id long, document_id long, event_date date, event_type string, title string, description string, diagnosis string, doctor string, source_type string"
    day = datetime.date(2024, 1, 2)
    old = [(1, 1, 1, day, "visita", "controllo ortopedico femore", "", "frattura", "Rossi", "altro")]
    new = [
        (1, 10, 2, day, "visita", "zeta valutazione", "", None, None, "altro"),
        (1, 11, 2, day, "visita", "alfa valutazione", "", "frattura", "Bianchi", "cartella_clinica"),
        (1, 12, 3, day, "visita", "alfa valutazione", "", "distorsione", "Bianchi", "altro"),
        (1, 13, 2, None, "esame", "esame", "", None, None, None),
        (1, 14, 4, day, "visita", "controllo ortopedico femore", "", None, None, None),
        (2, 15, 5, day, "visita", "altro caso", "", None, None, None),
    ]
    existing = spark.createDataFrame(old, kind).selectExpr("*", "7 AS order_number")
    got = {r.event_id: r for r in consolidated(existing, spark.createDataFrame(new, kind)).collect()}
    assert {k: (r.order_number, r.place, r.added) for k, r in got.items()} == {1: (7, 4, False), 13: (8, 1, True), 11: (9, 2, True), 12: (10, 3, True), 10: (11, 5, True), 15: (1, 1, True)}
    assert got[11].note == got[12].note == "diagnosi discordante: cartella_clinica (100)" and got[10].note is None and got[1].note is None


def test_inverted_file_is_written_once_and_finds_most_of_the_exact(spark, tmp_path):
    from caseweave.operators import vector, vector_index

    chunks = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = chunks.where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS vector")
    vector_index.build(chunks, "vec_id", "embedding", str(tmp_path / "index"))
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    df = vector_index.search(spark, str(tmp_path / "index"), queries, chunks, "vec_id", "embedding")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(r.query, r.vec_id): r.similarity for r in df.collect()}
    exact = {(r.query, r.vec_id): r.similarity for r in vector.nearest(chunks, queries, "vec_id", "embedding").collect()}
    common = set(exact) & set(found)
    assert len(exact) == 5 * queries.count() and len(common) >= 0.9 * len(exact)
    assert all(abs(found[k] - exact[k]) < 2e-6 for k in common)
    again = vector_index.search(spark, str(tmp_path / "index"), queries, chunks, "vec_id", "embedding")
    assert {(r.query, r.vec_id) for r in again.collect()} == set(found)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")} == written
    # every row is in the index, one with many copies in several packs
    assert spark.read.parquet(str(tmp_path / "index/lists")).agg({"n": "sum"}).first()[0] == chunks.count()


def test_inverted_file_of_odd_vectors(spark, tmp_path):
    from caseweave.operators import vector, vector_index

    rows = [(k, [1.0, 0.0]) for k in range(300)] + [(400, None), (401, [None, 1.0]), (402, [0.0, 0.0]), (403, [0.6, 0.8]), (None, [1.0, 0.0]), (404, [float("nan"), 1.0])]
    chunks = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([(403, [0.6, 0.8]), (7, [1.0, 0.0]), (1000, None), (1001, [1.0])], "query long, vector array<double>")
    vector_index.build(chunks.where("id IS NOT NULL"), "id", "v", str(tmp_path / "a"))
    got = vector_index.search(spark, str(tmp_path / "a"), asked, chunks, "id", "v", probes=99).collect()
    want = vector.nearest(chunks.where("id IS NOT NULL"), asked, "id", "v").collect()
    assert {(r.query, r.rank, r.similarity) for r in got} == {(r.query, r.rank, r.similarity) for r in want} and len(got) == len(want) == 10
    assert {r.id for r in want if r.query == 7} == {0, 1, 2, 3, 4}


def test_single_rows_and_the_audit_log(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    from caseweave.operators import details

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert details.single(rows, "k").count() == 2
    for bad, how in ((rows.union(rows), {}), (spark.createDataFrame([(1, None)], "k int, v string"), {})):
        with pytest.raises(PySparkException):
            details.single(bad, "k", **how).collect()
    assert details.single(spark.createDataFrame([(1, None)], "k int, v string"), "k", optional=True).count() == 1
    log = spark.createDataFrame([(None, "login", 1), (2, "logout", 2)], "user_id int, action string, at int")
    for _ in range(2):
        details.append_audit(log, f"file://{tmp_path}/audit")
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 4


def test_provenance_levels(spark):
    body = "Il paziente viene ricoverato per frattura del femore destro e operato il giorno seguente senza complicanze di rilievo"
    quotes = [(1, 0, "frattura del femore destro"), (1, 1, "FRATTURA  del femore\ndestro"), (1, 2, "ricoverato per una frattura del femore destro e operato il giorno"), (1, 3, "parole che non stanno affatto nel testo"), (1, 4, ""), (1, 5, None)]
    found = texts.provenance(spark.createDataFrame(quotes, "doc_id long, quote_id long, quote string"), spark.createDataFrame([(1, body)], "doc_id long, text string"))
    assert {r.quote_id: r.level for r in found.collect()} == {0: "exact", 1: "normalized", 2: "lcs", 3: "unverified", 4: "unverified", 5: "unverified"}


def test_sections_are_replaced_or_appended(spark):
    docs = spark.createDataFrame([(1, "intro\n## Danno biologico\nvecchio\n## Altro\nresta"), (2, "senza sezioni")], "case_id long, synthesis string")
    new = spark.createDataFrame([(1, "danno_biologico", "nuovo"), (2, "danno_biologico", "nuovo")], "case_id long, section_id string, content string")
    found = {r.case_id: r.synthesis for r in texts.replaced_section(docs, new, "case_id", "synthesis").collect()}
    assert found == {1: "intro\n\n## Danno biologico\n\nnuovo\n\n## Altro\n\nresta", 2: "senza sezioni\n\nnuovo"}


def test_discrepant_diagnoses_name_the_more_reliable_source(spark):
    rows = [(1, 1, 1, DAY("2024-01-01"), "visita", "controllo ortopedico ginocchio", "nota", "frattura", "altro"), (1, 2, 2, DAY("2024-01-01"), "visita", "controllo ortopedico ginocchio", "nota", "distorsione", "cartella_clinica")]
    t = spark.createDataFrame(rows, "case_id long, order_number int, document_id long, event_date date, event_type string, title string, description string, diagnosis string, source_type string")
    assert [r.note for r in links.discrepancies(t).collect()] == ["diagnosi discordante: cartella_clinica (100)"]


def test_excerpts_and_labels(spark):
    assert column(spark, text.excerpt(F.lit("a" * 200 + "Trova" + "b" * 200), "trova")) == "..." + "a" * 80 + "Trova" + "b" * 80 + "..."
    assert column(spark, text.excerpt(F.lit("corto"), "niente")) == "corto"
    assert text.search_term("(a%)") is None and text.search_term("a_b") == "a b"
    assert column(spark, dates.shown_date(F.lit("2024-03-05"))) == "05/03/2024"
    assert column(spark, text.jaccard(F.lit("uno"), F.lit("due"))) == 1.0
    assert column(spark, text.slug(F.lit("Cronologia, più  lunga!"))) == "cronologia_più_lunga"


def test_markdown_becomes_html():
    from caseweave.operators.reports import markdown_html

    found = markdown_html("# A & b\n- uno\n- **due**\n1. tre\n\n| x | y |\n|---|---|\n| 1 | <2> |\n---\ntesto *corsivo*")
    want = ["<h1>A &amp; b</h1>", "<ul>", "<li>uno</li>", "<li><strong>due</strong></li>", "</ul>", "<ol>", "<li>tre</li>", "</ol>", "<table>", "<tr><th>x</th><th>y</th></tr>", "<tr><td>1</td><td>&lt;2&gt;</td></tr>", "</table>", "<hr>", "<p>testo <em>corsivo</em></p>"]
    assert found.split("\n") == want
    assert markdown_html(None) == markdown_html("") == ""
    assert "<img" not in markdown_html("![x](javascript:alert)")


@pytest.mark.parametrize("raw", [None, "", "no json", "[]", '{"events": 3}', '{"events": []}'])
def test_answers_without_events(spark, raw):
    from caseweave.operators.records import extracted

    assert extracted(spark.createDataFrame([(1, raw)], "id long, raw string"), "id", "raw").count() == 0


def test_ingested_chunks_have_unit_vectors(spark):
    from caseweave.operators.reports import ingested

    rows = ingested(spark.createDataFrame([(1, "# T\n" + "parola diversa " * 300), (2, None), (3, "x")], "doc_id long, text string"), "doc_id", "text").collect()
    assert len(rows) > 2 and all(abs(sum(v * v for v in r.embedding) - 1) < 1e-5 for r in rows)


def test_written_csv_begins_with_the_header(spark, tmp_path):
    from caseweave.sources import files

    t = case(spark, ("2024-01-10", "visita", 'a;"b"', ""), ("1900-01-01", "esame", "c", "d"))
    extra = dict.fromkeys(("doctor", "facility"), F.lit(None).cast("string")) | {"date_precision": F.lit("giorno"), "source_type": F.lit("altro"), "confidence": F.lit(70), "requires_verification": F.lit(True)}
    files.write_csv(t.withColumns(extra), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv" / "case_id=1").glob("part-*")).read_text(encoding="utf-8-sig").splitlines()
    assert lines == [";".join(files.CSV_COLUMNS), "1;Data non documentata;giorno;esame;c;d;altro;;;;70;Si", '2;10/01/2024;giorno;visita;"a;""b""";;altro;;;;70;Si']


def test_demo_case_is_loaded_once(spark):
    from caseweave.sources import files

    codes = spark.createDataFrame([("CASO-1",)], "code string")
    assert files.demo_cases(spark, codes).count() == 1
    assert files.demo_cases(spark, codes.unionByName(files.demo_cases(spark, codes).select("code"))).count() == 0
