"""Queries over model answers and record states, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.functions.text import RELIABILITY
from caseweave.operators import links, records, rules, similar, tables, timeline
from caseweave.sources import views
from caseweave.sources.views import read, with_views


def _answers(spark, sf_dir):
    """Answers built from orders: whole, cut off in a text, cut off in an object, of another key, empty."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit('{"eventDate": "2024-01-0'), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit('", "eventType": "visita", "title": "t'), k, F.lit('", "diagnosis": "DIAGNOSI_PLACEHOLDER", "confidence": '), (F.col("o_orderkey") % 150).cast("string"), F.lit("}"))
    two = F.concat(F.lit('{"event_date": null, "event_type": "esame", "description": "d'), k, F.lit('", "source_pages": [2, 3]}'))
    whole = F.concat(F.lit('{"events": ['), one, F.lit(", "), two, F.lit("]}"))
    raw = F.when(F.col("o_orderkey") % 5 == 0, whole).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit('{"events": ['), one, F.lit(', {"title": "cut o'))).when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit('{"eventi": ['), two, F.lit("]}"))).when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit('{"events": ['), one)).otherwise("no json at all")
    return o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


def extracted_events(spark, sf_dir):
    found = records.extracted(_answers(spark, sf_dir), "id", "raw")
    return found.withColumn("source_pages", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ","))


def grounding_flags(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    q = F.when(F.col("doc_id") % 4 == 0, F.substring("text", 11, 100)).when(F.col("doc_id") % 4 == 1, F.regexp_replace(F.substring("text", 1, 50), " ", "  ")).when(F.col("doc_id") % 4 == 2, "breve").otherwise("una frase che non sta nel testo")
    kind = F.when(F.col("doc_id") % 3 == 0, "intervento").otherwise("visita")
    return records.grounding(d.select("doc_id", F.lit(0).alias("quote_id"), q.alias("quote"), kind.alias("event_type")), d)


def page_marks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    t = F.concat("text", F.repeat(F.lit(" [Manoscritto]"), (F.col("doc_id") % 4).cast("int")))
    kind, sure = records.handwriting(t)
    return d.select("doc_id", kind.alias("kind"), sure.cast("long").alias("sure"))


def image_types(spark, sf_dir):
    names = views.pick(["RX torace", "TAC encefalo", "rmn", "Ecografia addome", "other", "fotografia", "endoscopica"], F.col("p_partkey"))
    return read(spark, sf_dir, "part").groupBy(records.image_type(names).alias("kind")).agg(F.count("*").alias("n"))


MESSAGES = ["OCR timed out", "HTTP 429", "fetch failed", "401 Unauthorized", "file is too large", "Invalid mime type", "synthesis did fail", "503", "boom", "404 page", "errore interno", "extraction will fail"]


def error_kinds(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(records.error_kind(views.pick(MESSAGES, F.col("p_partkey"))).alias("kind")).agg(F.count("*").alias("n"))


STAGES = ["completato", "generazione_report", "revisione_anomalie", "revisione_classificazione", "elaborazione", "errore", "idle"]


def wizard_steps(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("_e"))
    rows = c.join(orders, "c_custkey", "left")
    return rows.select("c_custkey", records.wizard_step(views.pick(STAGES, k), k % 5 == 0, F.coalesce("_e", F.lit(False)), k % 2 == 0).cast("long").alias("step"))


def servable_images(spark, sf_dir):
    d = views.case_documents(spark, sf_dir).select("case_id", "document_id", "part")
    path = F.when(F.col("part") % 4 == 0, F.concat(F.lit("ocr-images/"), F.col("document_id").cast("string"), F.lit("/p1.png"))).when(F.col("part") % 4 == 1, F.concat(F.lit("ocr-images/../"), F.col("document_id").cast("string"))).when(F.col("part") % 4 == 2, F.concat(F.lit("ocr-images/"), (F.col("document_id") + 100).cast("string"), F.lit("/p1.png"))).otherwise("x/y.png")
    return records.servable(d.select("case_id", path.alias("image_path")), d)


def _sourced(spark, sf_dir):
    return views.timeline_sparse(spark, sf_dir).withColumn("source_type", views.pick(["cartella_clinica", "esame_ematochimico", "altro", "ignota"], F.col("event_id")))


def prompt_lines(spark, sf_dir):
    return records.event_lines(_sourced(spark, sf_dir), 10)


def report_splits(spark, sf_dir):
    return records.split_needed(views.timeline_dense(spark, sf_dir), 2000)


def anomaly_event_refs(spark, sf_dir):
    t = views.timeline_sparse(spark, sf_dir).withColumn("source_pages", F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), (F.col("event_id") % 7).cast("int"))))
    files = spark.range(3).select(F.col("id").alias("document_id"), F.concat(F.lit("doc"), F.col("id").cast("string"), F.lit(".pdf")).alias("file_name"))
    return records.anomaly_references(rules.documentation_gaps(t), t, files)


def anomaly_context(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("document_id"), F.col("doc_id").alias("page_number"), F.coalesce("text", F.lit("")).alias("ocr_text"))
    wanted = pages.select(F.floor(F.col("page_number") / 10).alias("key"), "document_id", "page_number")
    return records.ocr_context(wanted, pages).select("key", F.length("context").cast("long").alias("length"), F.md5(F.col("context").cast("binary")).alias("digest"))


def resolutions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return records.resolved(e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 != 0).alias("resolved"), (F.col("value") / 20).alias("confidence"), F.repeat(F.col("props"), 60).alias("evidence"))).withColumn("confidence", F.round("confidence", 6))


def case_bundle(spark, sf_dir):
    docs = views.case_documents(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("documents"), F.sum("pages").cast("long").alias("pages"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("states"))
    joined = views.cases(spark, sf_dir).join(docs, "case_id", "left")
    return joined.select("case_id", "user_id", "case_type", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("states", F.lit("")).alias("states"))


def case_filled(spark, sf_dir):
    k = F.col("case_id")
    return case_bundle(spark, sf_dir).select("case_id", records.filled([F.col("documents") > 0, k % 2 == 0, k % 3 == 0, k % 5 == 0, F.col("pages") > 100, F.col("states").contains("errore")]).alias("percent"))


def stuck_documents(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    last = tables.latest(e.select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return last.select("user_id", ((F.lit("2024-01-30 23:00:00").cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")) > 1800).alias("stuck"))


def style_excerpts(spark, sf_dir):
    wanted = views.cases(spark, sf_dir).select("case_id", F.col("case_type").alias("kind"), F.when(F.col("case_id") % 2 == 0, "ctu").otherwise("ctp").alias("role"))
    offers = spark.createDataFrame([("ortopedica", "ctu", "o1"), ("rc_auto", "ctp", "r1"), ("oncologica", "ctu", "k1")], "kind string, role string, excerpt string")
    generic = spark.createDataFrame([("ctu", "g1")], "role string, _g string")
    found = wanted.join(F.broadcast(offers), ["kind", "role"], "left").join(F.broadcast(generic), "role", "left")  # tables of the code, a few rows
    return found.select("case_id", F.coalesce("excerpt", "_g").alias("excerpt"))


def source_groups(spark, sf_dir):
    t = _sourced(spark, sf_dir)
    group = F.when(F.col("source_type").isin(list(RELIABILITY)), F.col("source_type")).otherwise("altro")
    listed = F.array_sort(F.collect_list(F.struct("event_date", "order_number")))
    return t.withColumn("group", group).groupBy("case_id", "group").agg(F.array_join(F.transform(listed, lambda x: x["order_number"].cast("string")), ",").alias("orders"))


def report_references(spark, sf_dir):
    from caseweave.plans.texts import reports

    return reports(spark, sf_dir).select("case_id", F.array_join(F.transform(records.references(F.col("synthesis")), lambda x: x.cast("string")), ",").alias("refs"))


def anomaly_status(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = views.pick(["detected", "llm_resolved", "llm_confirmed", "user_confirmed", "user_dismissed"], F.col("event_id"))
    last = tables.latest(e.select("user_id", status.alias("status"), "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return last.where(F.col("status").isin("detected", "llm_confirmed", "user_confirmed")).select("user_id", "status")


def discrepancy_notes(spark, sf_dir):
    t = views.timeline_dense(spark, sf_dir).withColumns({"source_type": views.pick(["cartella_clinica", "esame_ematochimico", "altro"], F.col("event_id")), "title": F.lit("controllo periodico programmato"), "diagnosis": views.pick(["frattura", "distorsione"], F.floor(F.col("event_id") / 7))})
    return links.discrepancies(t)


def first_dates(spark, sf_dir):
    return views.timeline_sparse(spark, sf_dir).where(~timeline.undated()).groupBy("case_id").agg(F.min("event_date").alias("first_date"), F.min_by("event_type", "order_number").alias("first_type"))


def _scored(spark, sf_dir):
    """Events of users' cases with titles of their type alone and a confidence."""
    t = views.timeline_dense(spark, sf_dir)
    return t.withColumns({"title": F.col("event_type"), "confidence": (F.col("event_id") % 7).cast("double")})


def best_events(spark, sf_dir):
    """What is left of similar events of one document and date."""
    kept = similar.kept_similar_events(_scored(spark, sf_dir), ["case_id", "document_id"], "event_date", "order_number")
    return kept.select("case_id", "document_id", "event_date", "slot", "order_number", "confidence")


def kept_turns(spark, sf_dir):
    """What is left of similar turns of a conversation: the longer ones, as none has a confidence."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("description"), F.lit("").alias("title"), F.lit(None).cast("double").alias("confidence"))
    return similar.kept_similar_events(c, ["conv_id"], "role", "turn").select("conv_id", "role", "slot", "turn")


def rag_query_text(spark, sf_dir):
    """The first ten events of four types of a case as one search text."""
    t = views.timeline_sparse(spark, sf_dir).where(F.col("event_type").isin("diagnosi", "intervento", "complicanza", "terapia"))
    rows = t.withColumn("_k", F.row_number().over(timeline.in_order())).where(F.col("_k") <= 10)
    listed = F.array_sort(F.collect_list(F.struct("order_number", F.concat("title", F.lit(": "), F.substring("description", 1, 150)).alias("line"))))
    return rows.groupBy("case_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), " ").alias("query"))


def reclassified(spark, sf_dir):
    """Documents' types after a classifier's answers: taken where the type was open, the answer is not, and it is sure enough."""
    d = views.case_documents(spark, sf_dir).select("document_id", F.when(F.col("part") % 2 == 0, "altro").otherwise("referto").alias("kind"), "part")
    answers = d.where(F.col("part") % 3 != 0).select("document_id", F.when(F.col("part") % 5 == 0, "altro").otherwise("lettera").alias("_new"), (F.col("part") % 100).alias("_sure"))
    taken = (F.col("kind") == "altro") & (F.col("_new") != "altro") & (F.col("_sure") >= 50)
    return d.join(answers, "document_id", "left").select("document_id", F.when(taken, F.col("_new")).otherwise(F.col("kind")).alias("kind"))


def first_images(spark, sf_dir):
    """The first image of each page that has an analysis; pages without an image keep null."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("page"), "p_partkey")
    first = p.where(F.col("page") % 4 != 0).groupBy("page").agg(F.min("p_partkey").alias("image"))
    return p.select("page").distinct().join(first, "page", "left")


def abbreviations(spark, sf_dir):
    """Abbreviations once in any case, as they stand first."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("short"))
    return p.groupBy(F.lower("short").alias("key")).agg(F.min_by("short", "p_partkey").alias("short"))


QUERIES = {f.__name__: f for f in (
    best_events, kept_turns, rag_query_text, reclassified, first_images, abbreviations, extracted_events, grounding_flags, page_marks, image_types, error_kinds, wizard_steps, servable_images, prompt_lines, report_splits, anomaly_event_refs, anomaly_context, resolutions, case_bundle, case_filled,
    stuck_documents, style_excerpts, source_groups, report_references, anomaly_status, discrepancy_notes, first_dates,
)}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _fold_sql(src: str, keys: str, carried: str) -> str:
    """A fold step by step: each event joins the kept ones of its group, in the place of the first similar one if it is better."""
    words = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[^A-Za-z0-9_àèéìòù\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 3))"
    fields = ", ".join(f"'{c}': {c}" for c in carried.split(", "))
    joined = " AND ".join(f"f.{k} IS NOT DISTINCT FROM o.{k}" for k in keys.split(", "))
    own = ", ".join(f"f.{k}" for k in keys.split(", "))
    shared = "len(list_intersect(x.w, new.w))"
    alike = f"CASE WHEN len(x.w) = 0 AND len(new.w) = 0 THEN true WHEN len(x.w) = 0 OR len(new.w) = 0 THEN false ELSE {shared}::DOUBLE / (len(x.w) + len(new.w) - {shared}) > 0.6::DOUBLE END"
    return f"""{src.replace("WITH", "WITH RECURSIVE", 1)}, o AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS rn, {{'w': {words}, 's': 10 * coalesce(confidence, 0) + length(coalesce(description, '')), {fields}}} AS new FROM src),
        f AS (SELECT {keys}, rn, [new] AS kept FROM o WHERE rn = 1 UNION ALL
            SELECT {keys}, rn, CASE WHEN pos IS NULL THEN list_append(kept, new) ELSE list_transform(kept, lambda x, i: CASE WHEN i = pos AND new.s > x.s THEN new ELSE x END) END FROM
            (SELECT {own}, o.rn, kept, new, nullif(list_position(list_transform(kept, lambda x: {alike}), true), 0) AS pos FROM f JOIN o ON o.rn = f.rn + 1 AND {joined})),
        whole AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rn DESC) AS k FROM f), slots AS (SELECT {keys}, unnest(kept) AS e, generate_subscripts(kept, 1) AS i FROM whole WHERE k = 1)
        SELECT {keys}, CAST(i - 1 AS INTEGER) AS slot, {", ".join(f"e.{c} AS {c}" for c in carried.split(", "))} FROM slots"""


def _sql() -> dict[str, str]:
    from caseweave.plans.texts import REPORTS
    from caseweave.plans.timelines import gaps_sql

    images = "CASE " + " ".join(f"WHEN contains(lower(raw), '{w}') THEN '{k}'" for k, ws in records.IMAGE_KEYWORDS.items() for w in ws) + " WHEN lower(raw) IN ('altro', 'other') THEN 'altro' ELSE raw END"
    errors = "CASE " + " ".join(f"WHEN regexp_matches(raw, '(?i){p}') THEN '{k}'" for k, p in records.ERRORS) + " ELSE 'other' END"
    bundle = with_views("cases", "case_documents") + ", b AS (SELECT c.case_id, c.user_id, c.case_type, coalesce(n, 0) AS documents, coalesce(p, 0) AS pages, coalesce(s, '') AS states FROM cases c LEFT JOIN (SELECT case_id, count(*) AS n, CAST(sum(pages) AS BIGINT) AS p, string_agg(DISTINCT status, ',' ORDER BY status) AS s FROM case_documents GROUP BY case_id) d USING (case_id)) "
    sourced = with_views("sparse") + ", t AS (SELECT *, list_extract(['cartella_clinica', 'esame_ematochimico', 'altro', 'ignota'], CAST(event_id % 4 AS INTEGER) + 1) AS source_type FROM sparse) "
    score = "CASE source_type WHEN 'cartella_clinica' THEN 100 WHEN 'esame_ematochimico' THEN 70 ELSE 50 END"
    first = "SELECT o_orderkey AS id, 0 AS number, '2024-01-0' || (o_orderkey % 9 + 1) AS event_date, 'sconosciuta' AS date_precision, 'visita' AS event_type, 't' || o_orderkey AS title, '' AS description, 'altro' AS source_type, NULL AS diagnosis, NULL AS doctor, NULL AS facility, least(o_orderkey % 150, 100)::DOUBLE AS confidence, FALSE AS requires_verification, '' AS source_text, '1' AS source_pages FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)"
    second = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END, '1900-01-01', 'sconosciuta', 'esame', 'Evento clinico', 'd' || o_orderkey, 'altro', NULL, NULL, NULL, 70.0::DOUBLE, TRUE, '', '2,3' FROM orders WHERE o_orderkey % 5 IN (0, 2)"
    third = "SELECT o_orderkey, 1, '1900-01-01', 'sconosciuta', 'altro', 'cut o', '', 'altro', NULL, NULL, NULL, 70.0::DOUBLE, TRUE, '', '1' FROM orders WHERE o_orderkey % 5 = 1"
    low = "regexp_replace(lower(text), '\\s+', ' ', 'g')"
    return {
        "best_events": _fold_sql(with_views("dense") + ", src AS (SELECT case_id, document_id, event_date, order_number, order_number AS ord, CAST(event_id % 7 AS DOUBLE) AS confidence, event_type AS title, description FROM dense)", "case_id, document_id, event_date", "order_number, confidence"),
        "kept_turns": _fold_sql("WITH src AS (SELECT conv_id, role, turn, turn AS ord, CAST(NULL AS DOUBLE) AS confidence, '' AS title, text AS description FROM conversations)", "conv_id, role", "turn"),
        "rag_query_text": with_views("sparse") + "SELECT case_id, string_agg(title || ': ' || substring(description, 1, 150), ' ' ORDER BY order_number) AS query FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY order_number) AS k FROM sparse WHERE event_type IN ('diagnosi', 'intervento', 'complicanza', 'terapia')) WHERE k <= 10 GROUP BY case_id",
        "reclassified": with_views("case_documents") + "SELECT d.document_id, CASE WHEN d.part % 2 = 0 AND a.part % 5 <> 0 AND a.part % 100 >= 50 THEN 'lettera' WHEN d.part % 2 = 0 THEN 'altro' ELSE 'referto' END AS kind FROM case_documents d LEFT JOIN case_documents a ON a.document_id = d.document_id AND a.part % 3 <> 0",
        "first_images": "SELECT p_partkey % 300 AS page, min(p_partkey) FILTER (WHERE p_partkey % 300 % 4 <> 0) AS image FROM part GROUP BY 1",
        "abbreviations": "SELECT lower(p_brand) AS key, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END, p_partkey) AS short FROM part GROUP BY 1",
        "anomaly_context": """WITH RECURSIVE p AS (SELECT doc_id // 10 AS key, doc_id // 20 AS d, doc_id AS n, coalesce(text, '') AS t FROM documents), o AS (SELECT *, chr(10) || '--- Pagina ' || d || ':' || n || ' ---' || chr(10) AS h, row_number() OVER (PARTITION BY key ORDER BY d, n, t) AS k FROM p),
            c AS (SELECT key, k, h || substring(t, 1, 5000) AS all_ FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, CASE WHEN length(all_) >= 5000 THEN all_ ELSE all_ || h || substring(t, 1, 5000 - length(all_)) END FROM c JOIN o ON o.key = c.key AND o.k = c.k + 1)
            SELECT key, length(trim(all_)) AS length, md5(trim(all_)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC) AS l FROM c) WHERE l = 1""",
        "extracted_events": f"{first} UNION ALL {second} UNION ALL {third}",
        "grounding_flags": f"""WITH q AS (SELECT doc_id, {low} AS t, CASE doc_id % 4 WHEN 0 THEN substring(text, 11, 100) WHEN 1 THEN replace(substring(text, 1, 50), ' ', '  ') WHEN 2 THEN 'breve' ELSE 'una frase che non sta nel testo' END AS quote, doc_id % 3 = 0 AS c FROM documents), s AS (SELECT *, trim(regexp_replace(lower(substring(quote, 1, 60)), '\\s+', ' ', 'g')) AS b FROM q),
            f AS (SELECT doc_id, c, CASE WHEN length(quote) < 10 THEN 'short' WHEN length(b) >= 10 AND NOT contains(t, b) THEN 'absent' ELSE 'fine' END AS f FROM s) SELECT doc_id, 0 AS quote_id, CASE WHEN f <> 'fine' AND c THEN 'critical_' || f ELSE f END AS flag FROM f""",
        "page_marks": "WITH r AS (SELECT doc_id, doc_id % 4 AS m, length(text) + 14 * (doc_id % 4) AS n FROM documents) SELECT doc_id, CASE WHEN m > 0 THEN CASE WHEN least(m * 200.0 / greatest(n, 1), 1) > 0.5 THEN 'yes' ELSE 'partial' END END AS kind, CASE WHEN m > 0 THEN CASE WHEN least(m * 200.0 / greatest(n, 1), 1) > 0.5 THEN 60 ELSE 70 END END::BIGINT AS sure FROM r",
        "image_types": f"SELECT {images} AS kind, count(*) AS n FROM (SELECT list_extract(['RX torace', 'TAC encefalo', 'rmn', 'Ecografia addome', 'other', 'fotografia', 'endoscopica'], CAST(p_partkey % 7 AS INTEGER) + 1) AS raw FROM part) GROUP BY 1",
        "error_kinds": f"SELECT {errors} AS kind, count(*) AS n FROM (SELECT list_extract({_list(MESSAGES)}, CAST(p_partkey % {len(MESSAGES)} AS INTEGER) + 1) AS raw FROM part) GROUP BY 1",
        "wizard_steps": f"""SELECT c_custkey, CAST(CASE WHEN s IN ('completato', 'generazione_report') THEN 5 WHEN s = 'revisione_anomalie' THEN 4 WHEN s IN ('revisione_classificazione', 'elaborazione') THEN 3 WHEN c_custkey % 5 = 0 THEN 5 WHEN e THEN 4 WHEN s = 'errore' OR c_custkey % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS step
            FROM (SELECT c_custkey, list_extract({_list(STAGES)}, CAST(c_custkey % 7 AS INTEGER) + 1) AS s, c_custkey IN (SELECT o_custkey FROM orders) AS e FROM customer)""",
        "servable_images": with_views("case_documents") + "SELECT d.case_id, 'ocr-images/' || CASE WHEN part % 4 = 0 THEN document_id ELSE document_id + 100 END || '/p1.png' AS image_path FROM case_documents d WHERE part % 4 = 0 OR (part % 4 = 2 AND EXISTS (SELECT 1 FROM case_documents o WHERE o.case_id = d.case_id AND o.document_id = d.document_id + 100))",
        "prompt_lines": sourced + f"SELECT case_id, string_agg('#' || order_number || ' ' || strftime(event_date, '%d/%m/%Y') || ' [' || upper(event_type) || '] (' || CASE WHEN {score} >= 80 THEN 'alta' WHEN {score} >= 60 THEN 'media' ELSE 'bassa' END || ' ' || {score} || ') ' || title || ': ' || description || coalesce(' | ' || diagnosis, ''), chr(10) ORDER BY order_number) FILTER (WHERE order_number <= 10) AS lines, count(*) AS events FROM t GROUP BY case_id",
        "report_splits": with_views("dense") + "SELECT case_id, CAST(sum(length(title || ' ' || description)) AS BIGINT) AS characters, sum(length(title || ' ' || description)) > 2000 AS split FROM dense GROUP BY case_id",
        "anomaly_event_refs": with_views("sparse") + f", i AS (SELECT case_id, order_a AS o FROM ({gaps_sql('sparse')}) UNION SELECT case_id, order_b FROM ({gaps_sql('sparse')})) SELECT i.case_id, o AS order_number, 'Evento #' || o || ': ' || title || CASE WHEN document_id < 3 THEN ' — Doc: doc' || document_id || '.pdf' || CASE WHEN event_id % 3 = 0 THEN ', pag. 1, ' || (event_id % 7) ELSE '' END ELSE '' END AS reference FROM i JOIN sparse s ON s.case_id = i.case_id AND s.order_number = o",
        "resolutions": "SELECT event_id AS id, event_id % 3 <> 0 AND least(greatest(value / 20, 0), 1) >= 0.8 AS accepted, round(least(greatest(value / 20, 0), 1), 6) AS confidence, substring(repeat(props, 60), 1, 500) AS evidence FROM events",
        "case_bundle": bundle + "SELECT * FROM b",
        "case_filled": bundle + "SELECT case_id, CAST(floor(100.0 * ((documents > 0)::INT + (case_id % 2 = 0)::INT + (case_id % 3 = 0)::INT + (case_id % 5 = 0)::INT + (pages > 100)::INT + contains(states, 'errore')::INT) / 6 + 0.5) AS BIGINT) AS percent FROM b",
        "stuck_documents": "SELECT user_id, epoch(TIMESTAMP '2024-01-30 23:00:00') - floor(epoch(max(ts))) > 1800 AS stuck FROM events GROUP BY user_id",
        "style_excerpts": with_views("cases") + "SELECT case_id, CASE WHEN case_type = 'ortopedica' AND case_id % 2 = 0 THEN 'o1' WHEN case_type = 'rc_auto' AND case_id % 2 = 1 THEN 'r1' WHEN case_type = 'oncologica' AND case_id % 2 = 0 THEN 'k1' WHEN case_id % 2 = 0 THEN 'g1' END AS excerpt FROM cases",
        "source_groups": sourced + "SELECT case_id, CASE WHEN source_type = 'ignota' THEN 'altro' ELSE source_type END AS \"group\", string_agg(CAST(order_number AS VARCHAR), ',' ORDER BY event_date, order_number) AS orders FROM t GROUP BY 1, 2",
        "report_references": f"WITH {REPORTS}, x AS (SELECT case_id, unnest(regexp_extract_all(synthesis, '\\[Ev\\.(\\d+)\\]', 1)) AS n, generate_subscripts(regexp_extract_all(synthesis, '\\[Ev\\.(\\d+)\\]', 1), 1) AS k FROM reports), f AS (SELECT case_id, n, min(k) AS k FROM x GROUP BY 1, 2) SELECT case_id, string_agg(n, ',' ORDER BY k) AS refs FROM f GROUP BY case_id",
        "anomaly_status": "SELECT user_id, status FROM (SELECT user_id, list_extract(['detected', 'llm_resolved', 'llm_confirmed', 'user_confirmed', 'user_dismissed'], CAST(event_id % 5 AS INTEGER) + 1) AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND status IN ('detected', 'llm_confirmed', 'user_confirmed')",
        "first_dates": with_views("sparse") + "SELECT case_id, min(event_date) AS first_date, arg_min(event_type, order_number) AS first_type FROM sparse WHERE year(event_date) <> 1900 GROUP BY case_id",
        "discrepancy_notes": with_views("dense") + """, t AS (SELECT case_id, order_number, document_id, event_date, event_type, list_extract(['cartella_clinica', 'esame_ematochimico', 'altro'], CAST(event_id % 3 AS INTEGER) + 1) AS s, list_extract([100, 70, 50], CAST(event_id % 3 AS INTEGER) + 1) AS r, list_extract(['frattura', 'distorsione'], CAST(event_id // 7 % 2 AS INTEGER) + 1) AS d FROM dense)
            SELECT a.case_id, a.order_number, string_agg('diagnosi discordante: ' || CASE WHEN a.r >= b.r THEN a.s ELSE b.s END || ' (' || greatest(a.r, b.r) || ')', '; ' ORDER BY b.order_number) AS note FROM t a JOIN t b ON a.case_id = b.case_id AND a.event_date = b.event_date AND a.event_type = b.event_type AND a.document_id <> b.document_id AND a.order_number < b.order_number AND a.d <> b.d GROUP BY 1, 2""",
    }


ORACLE_SQL = _sql()
