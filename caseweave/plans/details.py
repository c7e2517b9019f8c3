"""Queries over timelines, uploads, reports and their context, and consolidation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import packs
from caseweave.operators import details, rules, texts, timeline
from caseweave.plans.texts import _PARTS, REPORTS, _section_sql
from caseweave.plans.texts import reports as built
from caseweave.sources import files, views
from caseweave.sources.views import _list, read, with_views


def shown_events(spark, sf_dir):
    """The three views of a timeline: what awaits verification, the visits, all."""
    e = F.col("event_id")
    t = views.timeline_sparse(spark, sf_dir).withColumns({"requires_verification": e % 4 == 0, "event_date": F.when(e % 7 != 0, F.col("event_date"))})
    parts = {"open": details.shown_events(t, only_open=True), "visita": details.shown_events(t, kind="visita"), "all": details.shown_events(t)}
    rows = None
    for name, part in parts.items():
        counted = part.groupBy("case_id", "open").agg(F.count("*").alias("n")).withColumn("view", F.lit(name))
        rows = counted if rows is None else rows.unionByName(counted)
    return rows


def fresh_uploads(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("at"))
    return details.fresh_uploads(p.where(F.col("at") % 3 != 0), p.where(F.col("at") % 3 == 0))


def similar_turns(spark, sf_dir):
    """How alike each turn of a conversation is to the next one."""
    w = timeline.Window.partitionBy("conv_id").orderBy("turn", "role")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["conv_id", "turn", "role"])
    rows = c.withColumn("next", F.lead("text").over(w)).where(F.col("next").isNotNull())
    return rows.select("conv_id", "turn", "role", F.round(details.jaccard_of_plain(F.col("text"), F.col("next")), 6).alias("similarity"))


def _illustrated(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    image = lambda n: F.concat(F.lit("![Foto "), n.cast("string"), F.lit("](ocr-image:doc"), (n % 5).cast("string"), F.lit("/pagina "), (n % 3).cast("string"), F.lit(".png)"))
    return p.select(k.alias("case_id"), F.concat("p_name", F.lit(" "), F.when(k % 4 != 0, image(k)).otherwise(""), F.lit(" poi "), F.when(k % 2 == 0, image(k + 1)).otherwise(""), F.when(k % 6 == 1, image(k)).otherwise("")).alias("text"))


def image_placeholders(spark, sf_dir):
    return _illustrated(spark, sf_dir).select("case_id", F.array_join(details.image_paths(F.col("text")), ",").alias("paths"), details.with_image_addresses(F.col("text"), F.col("case_id")).alias("shown"))


def classifier_inputs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    asked = details.classifier_input(F.concat(F.lit("atto\n"), "source", F.lit(".pdf")), F.col("text"))
    return d.select("doc_id", F.md5(asked.cast("binary")).alias("digest"))


def section_contexts(spark, sf_dir):
    return details.section_context(views.timeline_dense(spark, sf_dir))


def report_excerpts(spark, sf_dir):
    r = built(spark, sf_dir)
    return r.select("case_id", F.md5(details.report_excerpt(F.col("synthesis")).cast("binary")).alias("digest"))


def surgeries_without_consent(spark, sf_dir):
    return rules.surgeries_without_consent(views.timeline_sparse(spark, sf_dir))


def question_contexts(spark, sf_dir):
    return details.question_lines(views.timeline_sparse(spark, sf_dir))


STEPS = ["in_coda", "errore", "completato"]


def case_progress(spark, sf_dir):
    return details.progress(views.case_documents(spark, sf_dir).withColumn("started", F.col("updated_on")), STEPS)


def provisional_numbers(spark, sf_dir):
    docs = views.case_documents(spark, sf_dir).select("document_id", F.col("pages").cast("int").alias("n_pages"))
    found = timeline.page_chunks(docs).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return found.select("document_id", details.provisional_number(F.col("first_page"), F.col("_k")).cast("long").alias("number"))


def single_reports(spark, sf_dir):
    """The one report of each case."""
    return details.single(built(spark, sf_dir), "case_id").select("case_id", F.length("synthesis").cast("long").alias("length"))


def _sections() -> list[tuple[str, int, str]]:
    """Sections of the case types: common ones, one of each type's own, and for some none on relevant elements."""
    rows = []
    for k, kind in enumerate(packs.CASE_TYPES):
        names = ["riassunto", "cronologia", f"proprio_{k}", *(["elementi_rilievo"] if k % 4 != 3 else []), "conclusioni", f"gruppo_{k % 3}"]
        rows += [(kind, place, name) for place, name in enumerate(names)]
    return rows


def combined_sections(spark, sf_dir):
    k = F.col("o_orderkey")
    types = F.array(views.pick(packs.CASE_TYPES, k), views.pick(packs.CASE_TYPES, F.floor(k / 13)), views.pick(packs.CASE_TYPES, F.floor(k / 169)))
    wanted = read(spark, sf_dir, "orders").select(k.alias("key"), F.array_distinct(types).alias("types"))
    found = details.combined_sections(wanted, F.broadcast(spark.createDataFrame(_sections(), "case_type string, place int, section_id string")))
    return found.select("key", F.array_join("sections", ",").alias("sections"))


def _calculated(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    day = lambda n, s: F.when(k % s != 0, k % n)
    return c.select(k.alias("case_id"), F.explode(F.array(F.struct(F.lit("ITT").alias("label"), day(40, 5).alias("days")), F.struct(F.lit("Invalidità temporanea parziale").alias("label"), day(30, 3).alias("days")), F.struct(F.lit("Durata ricovero").alias("label"), day(20, 11).alias("days")))).alias("x")).select("case_id", "x.*")


def report_numbers(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Danno. ITT: "), (k % 43).cast("string"), F.lit(" giorni. Invalidità temporanea parziale "), (k % 29).cast("string"), F.lit(" giorni; giorni di ricovero: "), (k % 23).cast("string"))
    return details.number_mismatches(read(spark, sf_dir, "customer").select(k.alias("case_id"), text.alias("synthesis")), _calculated(spark, sf_dir))


def checked_values(spark, sf_dir):
    k = F.col("o_orderkey")
    date = F.when(k % 6 == 0, "marzo 2020").when(k % 6 == 1, "2020-13-40").when(k % 6 == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "))).when(k % 6 != 3, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return details.checked_values(read(spark, sf_dir, "orders").select(k.alias("event_id"), date.alias("date"), (k % 160 - 20).cast("double").alias("confidence")))


def consolidation_notes(spark, sf_dir):
    e = F.col("event_id")
    t = views.timeline_dense(spark, sf_dir).withColumns({"source_type": views.pick(["cartella_clinica", "esame_ematochimico", "altro"], e), "title": F.lit("controllo periodico programmato"), "diagnosis": views.pick(["frattura", "distorsione"], F.floor(e / 7)), "doctor": F.when(e % 3 != 0, views.pick(["Rossi", "Bianchi"], F.floor(e / 5)))})
    return details.cross_notes(t)


def consolidated_events(spark, sf_dir):
    t = views.timeline_dense(spark, sf_dir).drop("order_number")
    existing = timeline.numbered(t.where(F.col("event_id") % 2 == 0))
    return details.consolidated(existing, t.where(F.col("event_id") % 2 == 1)).select("case_id", "event_id", "order_number", "added", "place")


def replaced_sections(spark, sf_dir):
    r = built(spark, sf_dir)
    new = r.select("case_id", F.lit("danno_biologico").alias("section_id"), F.concat(F.lit(" nuovo testo "), F.col("case_id").cast("string"), F.lit("\n")).alias("content"))
    return texts.replaced_section(r, new, "case_id", "synthesis").select("case_id", F.md5(F.col("synthesis").cast("binary")).alias("digest"))


def ocr_pages(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    page = lambda a, n: F.struct(F.substring(F.coalesce("text", F.lit("")), a, n).alias("markdown"), F.when(k % 3 == 0, F.array(F.concat(F.lit("<table>"), k.cast("string"), F.lit("</table>")))).alias("tables"), ((k + a) % 100 + 0.5).alias("confidence"))
    found = files.ocr_pages(d.select(k.alias("document_id"), F.array(page(1, 400), page(401, 10**9)).alias("pages")))
    return found.select("document_id", "page_number", F.md5(F.col("ocr_text").cast("binary")).alias("digest"), "confidence")


QUERIES = {f.__name__: f for f in (
    shown_events, fresh_uploads, similar_turns, image_placeholders, classifier_inputs, section_contexts, report_excerpts, surgeries_without_consent, question_contexts, case_progress, provisional_numbers, single_reports, combined_sections,
    report_numbers, checked_values, consolidation_notes, consolidated_events, replaced_sections, ocr_pages,
)}


def _sql() -> dict[str, str]:
    from caseweave.functions import text

    stop = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
    words = lambda x, n: f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: length(w) > {n})"
    plain = lambda x: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^A-Za-z0-9_àèéìòù\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 3))"
    jac = lambda x, y: f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0::DOUBLE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE END"
    uniq = lambda x: f"list_distinct({words(x, 3)})"
    keys = lambda x: f"list_filter({words(x, 3)}, lambda w: w NOT IN {stop})[1:30]"
    like = lambda a, b: f"({jac(uniq(a + '.title'), uniq(b + '.title'))} > 0.6 OR len(list_filter({keys(a + '.description')}, lambda w: list_contains({keys(b + '.description')}, w))) >= 3)"
    open_events = with_views("sparse") + ", e AS (SELECT *, event_id % 4 = 0 OR event_id % 7 = 0 AS open FROM sparse) "
    image = lambda n: f"'![Foto ' || ({n}) || '](ocr-image:doc' || (({n}) % 5) || '/pagina ' || (({n}) % 3) || '.png)'"
    told = f"p_name || ' ' || CASE WHEN p_partkey % 4 <> 0 THEN {image('p_partkey')} ELSE '' END || ' poi ' || CASE WHEN p_partkey % 2 = 0 THEN {image('p_partkey + 1')} ELSE '' END || CASE WHEN p_partkey % 6 = 1 THEN {image('p_partkey')} ELSE '' END"
    sections = ", ".join(f"('{t}', {p}, '{s}')" for t, p, s in _sections())
    kind = lambda k: f"list_extract({_list(packs.CASE_TYPES)}, CAST({k} % {len(packs.CASE_TYPES)} AS INTEGER) + 1)"
    date = "CASE o_orderkey % 6 WHEN 0 THEN 'marzo 2020' WHEN 1 THEN '2020-13-40' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' ' WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END"
    clean = lambda x: f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
    notes = f""", t AS (SELECT case_id, order_number, document_id, event_date, event_type, description, 'controllo periodico programmato' AS title, list_extract(['cartella_clinica', 'esame_ematochimico', 'altro'], CAST(event_id % 3 AS INTEGER) + 1) AS s, list_extract([100, 70, 50], CAST(event_id % 3 AS INTEGER) + 1) AS r,
        list_extract(['frattura', 'distorsione'], CAST(event_id // 7 % 2 AS INTEGER) + 1) AS d, CASE WHEN event_id % 3 <> 0 THEN list_extract(['Rossi', 'Bianchi'], CAST(event_id // 5 % 2 AS INTEGER) + 1) END AS m FROM dense),
        p AS (SELECT a.case_id, a.order_number AS o, b.order_number AS b, CASE WHEN a.d <> b.d THEN 'diagnosi discordante: ' || CASE WHEN a.r >= b.r THEN a.s ELSE b.s END || ' (' || greatest(a.r, b.r) || ')' END AS n, CASE WHEN a.m <> b.m THEN 'medico diverso: ' || b.m END AS k
            FROM t a JOIN t b ON a.case_id = b.case_id AND a.event_date = b.event_date AND a.event_type = b.event_type AND a.document_id <> b.document_id AND a.order_number <> b.order_number),
        f AS (SELECT *, row_number() OVER (PARTITION BY case_id, o ORDER BY b) = 1 AND n IS NULL AND k IS NULL AS first FROM p)
        SELECT case_id, o AS order_number, string_agg(concat_ws('; ', CASE WHEN first THEN 'fonti concordi' END, n, k), '; ' ORDER BY b) FILTER (WHERE first OR n IS NOT NULL OR k IS NOT NULL) AS note FROM f GROUP BY 1, 2"""
    return {
        "shown_events": open_events + "SELECT case_id, open, count(*) AS n, 'open' AS view FROM e WHERE open GROUP BY 1, 2 UNION ALL SELECT case_id, open, count(*), 'visita' FROM e WHERE event_type = 'visita' GROUP BY 1, 2 UNION ALL SELECT case_id, open, count(*), 'all' FROM e GROUP BY 1, 2",
        "fresh_uploads": "SELECT p_name AS name, p_size AS size, min(p_partkey) AS at FROM part a WHERE p_partkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 3 = 0 AND b.p_name = a.p_name AND b.p_size = a.p_size) GROUP BY 1, 2",
        "similar_turns": f"WITH c AS (SELECT conv_id, turn, role, any_value(coalesce(text, '')) AS text FROM conversations GROUP BY ALL), n AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next FROM c), w AS (SELECT conv_id, turn, role, {plain('text')} AS x, {plain('next')} AS y FROM n WHERE next IS NOT NULL) SELECT conv_id, turn, role, round({jac('x', 'y')}, 6) AS similarity FROM w",
        "image_placeholders": f"WITH t AS (SELECT p_partkey AS case_id, {told} AS text FROM part), x AS (SELECT case_id, unnest(regexp_extract_all(text, '\\(ocr-image:([^)]+)\\)', 1)) AS p, generate_subscripts(regexp_extract_all(text, '\\(ocr-image:([^)]+)\\)', 1), 1) AS k FROM t), f AS (SELECT case_id, p, min(k) AS k FROM x GROUP BY 1, 2), g AS (SELECT case_id, string_agg(p, ',' ORDER BY k) AS paths FROM f GROUP BY 1) SELECT t.case_id, coalesce(paths, '') AS paths, regexp_replace(text, '!\\[([^\\]]*)\\]\\(ocr-image:([^/)]+)/pagina ([^)]+)\\)', '![\\1](/api/cases/' || t.case_id || '/images?path=\\2%2Fpagina%20\\3)', 'g') AS shown FROM t LEFT JOIN g USING (case_id)",
        "classifier_inputs": "SELECT doc_id, md5('Nome file: ' || substring('atto ' || source || '.pdf', 1, 100) || chr(10) || chr(10) || 'Testo documento (prime ' || length(substring(coalesce(text, ''), 1, 3000)) || ' caratteri):' || chr(10) || substring(coalesce(text, ''), 1, 3000)) AS digest FROM documents",
        "section_contexts": with_views("dense") + ", r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY order_number) AS k, count(*) OVER (PARTITION BY case_id) AS n FROM dense) SELECT case_id, n AS events, string_agg(strftime(event_date, '%d/%m/%Y') || ' | ' || event_type || ': ' || title || ' — ' || substring(description, 1, CASE WHEN n > 30 THEN 200 ELSE 300 END), chr(10) ORDER BY k) || CASE WHEN n > 30 THEN chr(10) || '... (' || (n - 30) || ' altri eventi)' ELSE '' END AS context FROM r WHERE k <= 30 GROUP BY 1, 2",
        "report_excerpts": f"WITH {REPORTS} SELECT case_id, md5(substring(synthesis, 1, 4000) || CASE WHEN length(synthesis) > 4000 THEN chr(10) || '...(troncato)' ELSE '' END) AS digest FROM reports",
        "surgeries_without_consent": with_views("sparse") + "SELECT case_id, count(*) AS surgeries, array_to_string(list_sort(list(order_number))[1:3], ',') AS listed FROM sparse WHERE event_type = 'intervento' AND case_id NOT IN (SELECT case_id FROM sparse WHERE event_type = 'consenso') GROUP BY case_id",
        "question_contexts": with_views("sparse") + "SELECT case_id, string_agg('#' || order_number || ' ' || strftime(event_date, '%Y-%m-%d') || ' [' || event_type || '] ' || title || ': ' || substring(description, 1, 200) || coalesce(' | Diagnosi: ' || diagnosis, ''), chr(10) ORDER BY order_number) AS lines FROM sparse GROUP BY case_id",
        "case_progress": with_views("case_documents") + f"SELECT case_id, min(updated_on) FILTER (WHERE status <> 'in_coda') AS started, CAST(min(list_position({_list(STEPS)}, status) - 1) AS BIGINT) AS step FROM case_documents GROUP BY case_id",
        "provisional_numbers": with_views("case_documents") + "SELECT document_id, CAST(c * 1000 + k + 1 AS BIGINT) AS number FROM case_documents, LATERAL unnest(generate_series(0, CAST(ceil(pages / 10.0) AS BIGINT) - 1)) u(c), (VALUES (0), (1), (2)) v(k) WHERE pages > 0",
        "single_reports": f"WITH {REPORTS} SELECT case_id, length(synthesis) AS length FROM reports",
        "combined_sections": f"""WITH s(case_type, place, section_id) AS (VALUES {sections}), w AS (SELECT o_orderkey AS key, 0 AS t, {kind('o_orderkey')} AS case_type FROM orders UNION ALL SELECT o_orderkey, 1, {kind('(o_orderkey // 13)')} FROM orders UNION ALL SELECT o_orderkey, 2, {kind('(o_orderkey // 169)')} FROM orders),
            r AS (SELECT key, t, place, section_id, row_number() OVER (PARTITION BY key, section_id ORDER BY t, place) AS k FROM w JOIN s USING (case_type)), l AS (SELECT *, min(CASE WHEN section_id = 'elementi_rilievo' AND t = 0 THEN place END) OVER (PARTITION BY key) AS last FROM r WHERE k = 1)
            SELECT key, string_agg(section_id, ',' ORDER BY CASE WHEN section_id = 'elementi_rilievo' THEN 2 WHEN t > 0 THEN 1 WHEN place > last THEN 3 ELSE 0 END, t, place) AS sections FROM l GROUP BY key""",
        "report_numbers": """WITH v AS (SELECT c_custkey AS case_id, 'ITT' AS measure, c_custkey % 43 AS told, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 END AS days FROM customer UNION ALL SELECT c_custkey, 'ITP', c_custkey % 29, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 30 END FROM customer UNION ALL SELECT c_custkey, 'Giorni ricovero', c_custkey % 23, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 20 END FROM customer)
            SELECT * FROM v WHERE abs(told - days) > 2""",
        "checked_values": f"WITH r AS (SELECT o_orderkey, {date} AS d, (o_orderkey % 160 - 20)::DOUBLE AS c FROM orders), f AS (SELECT *, coalesce(regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), FALSE) AND try_cast(d AS DATE) IS NOT NULL AS fine FROM r) SELECT o_orderkey AS event_id, CASE WHEN NOT fine THEN 'invalid_date' END AS issue, greatest(0.0::DOUBLE, least(100.0::DOUBLE, c)) AS confidence, c < 0 OR c > 100 AS clamped, NOT fine AS requires_verification FROM f",
        "consolidation_notes": with_views("dense") + notes,
        "consolidated_events": with_views("dense") + f""", old AS (SELECT * EXCLUDE (order_number), row_number() OVER (PARTITION BY case_id ORDER BY event_date, type_rank, event_id) AS order_number FROM dense WHERE event_id % 2 = 0), most AS (SELECT case_id, max(order_number) AS m FROM old GROUP BY 1),
            fresh AS (SELECT n.* EXCLUDE (order_number), coalesce(m, 0) + row_number() OVER (PARTITION BY n.case_id ORDER BY n.event_date, n.event_type, n.title, n.event_id) AS order_number FROM dense n LEFT JOIN most ON most.case_id = n.case_id WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.case_id = n.case_id AND o.event_date = n.event_date AND o.event_type = n.event_type AND {like('n', 'o')})),
            whole AS (SELECT case_id, event_id, order_number, event_date, event_type, title, FALSE AS added FROM old UNION ALL SELECT case_id, event_id, order_number, event_date, event_type, title, TRUE FROM fresh) SELECT case_id, event_id, order_number, added, row_number() OVER (PARTITION BY case_id ORDER BY event_date, event_type, title, order_number) AS place FROM whole""",
        "replaced_sections": f"""WITH {_PARTS}, k AS (SELECT *, {_section_sql('title')} AS section_id FROM secs), g AS (SELECT case_id, bool_or(section_id = 'danno_biologico') AS has, string_agg('## ' || title || chr(10) || chr(10) || CASE WHEN section_id = 'danno_biologico' THEN 'nuovo testo ' || case_id ELSE content END, chr(10) || chr(10) ORDER BY place) AS whole FROM k GROUP BY 1)
            SELECT r.case_id, md5(CASE WHEN has THEN {clean('whole')} ELSE r.synthesis || chr(10) || chr(10) || ' nuovo testo ' || r.case_id || chr(10) END) AS digest FROM reports r LEFT JOIN g USING (case_id)""",
        "ocr_pages": "SELECT doc_id AS document_id, n AS page_number, md5(CASE WHEN n = 1 THEN substring(coalesce(text, ''), 1, 400) ELSE substring(coalesce(text, ''), 401) END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '[TABLE_HTML_START]' || chr(10) || '<table>' || doc_id || '</table>' || chr(10) || '[TABLE_HTML_END]' ELSE '' END) AS digest, (doc_id + CASE WHEN n = 1 THEN 1 ELSE 401 END) % 100 + 1 AS confidence FROM documents, (VALUES (1), (2)) v(n)",
    }


ORACLE_SQL = _sql()
