"""Queries over case tables: filters, joins, aggregates, top rows, upkeep and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import packs
from caseweave.functions import dates, text
from caseweave.operators import links, rules, tables, timeline, vector
from caseweave.sources import views
from caseweave.sources.views import read, with_views

AS_OF, EVENTS_AS_OF = "2001-08-01", "2024-01-31 00:00:00"


def cases_by_status(spark, sf_dir):
    c = views.cases(spark, sf_dir)
    return c.where((F.col("status") == "archiviato") & F.col("case_type").isin("ortopedica", "rc_auto") & (F.col("amount") > 1000)).select("case_id", "user_id", "case_type")


def documents_in_range(spark, sf_dir):
    d = views.case_documents(spark, sf_dir)
    return d.where(F.col("number").between(2, 4) & (F.col("updated_on") >= F.lit("1998-01-01").cast("date")) & (F.col("updated_on") < F.lit("1998-07-01").cast("date")) & (F.col("status") != "errore")).select("document_id", "updated_on")


def owner_visible_docs(spark, sf_dir):
    viewers = views.profiles(spark, sf_dir).where(F.col("nation") == 3)
    return tables.visible(views.case_documents(spark, sf_dir), views.cases(spark, sf_dir), viewers).select("document_id", "case_id")


def retryable(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.where((F.col("event_type") == "error") & ~F.lower("props").contains('"k": 1')).select("event_id", "props")


def enum_fold(spark, sf_dir):
    names = views.pick(["surgery", "Follow Up", "visita", "LAB", "nota-spese", "??", "diagnosis", "pronto soccorso"], F.col("l_partkey"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", names.alias("raw"))
    return rows.groupBy(text.folded(F.col("raw"), packs.EVENT_TYPES, packs.EVENT_ALIASES).alias("event_type")).agg(F.count("*").alias("n"))


def feature_gate(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    status = views.pick(["active", "trialing", "canceled", "past_due", "trial"], F.col("c_custkey"))
    plan = views.pick(["pro", "enterprise", "trial"], F.col("c_custkey"))
    feature = views.pick(["processing", "export", "rag_guidelines", "section_regenerate"], F.col("c_nationkey"))
    rows = c.select(status.alias("status"), plan.alias("plan"), feature.alias("feature"))
    return rows.withColumn("open", tables.allowed(F.col("status"), F.col("plan"), F.col("feature"))).groupBy("status", "plan", "feature", "open").agg(F.count("*").alias("n"))


def status_transitions(spark, sf_dir):
    c = views.cases(spark, sf_dir).select("case_id", "user_id", F.col("status").alias("old"))
    new = F.lead("old").over(timeline.Window.partitionBy("user_id").orderBy("case_id"))
    rows = c.withColumn("new", new).where(F.col("new").isNotNull())
    return rows.groupBy("old", "new", tables.may_change(F.col("old"), F.col("new")).alias("fine")).agg(F.count("*").alias("n"))


def docs_case_code(spark, sf_dir):
    d = views.case_documents(spark, sf_dir).select("document_id", "case_id")
    codes = views.cases(spark, sf_dir).where(F.col("case_id") % 7 != 0).select("case_id", F.concat(F.lit("CASO-"), F.col("case_id").cast("string")).alias("code"))
    return links.with_name(d, codes, "case_id", "code")


def audit_user(spark, sf_dir):
    log = read(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"))
    names = views.profiles(spark, sf_dir).where(F.col("user_id") % 3 != 0)
    named = links.with_name(log, names, "user_id", "full_name")
    return named.select("event_id", F.when(F.col("user_id").isNull(), "system").otherwise(F.col("full_name")).alias("who"))


def user_case_counts(spark, sf_dir):
    return links.with_count(views.profiles(spark, sf_dir).select("user_id", "plan"), views.cases(spark, sf_dir), "user_id", "cases")


def _some_events(spark, sf_dir):
    return views.case_documents(spark, sf_dir).where(F.col("part") % 3 == 0).select("document_id")


def doc_coverage(spark, sf_dir):
    return links.coverage(views.case_documents(spark, sf_dir).select("document_id", "status"), _some_events(spark, sf_dir)).groupBy("coverage").agg(F.count("*").alias("n"))


def docs_without_events(spark, sf_dir):
    done = views.case_documents(spark, sf_dir).where(F.col("status") == "completato").select("document_id")
    return tables.many_without(done, _some_events(spark, sf_dir), "document_id")


def _image_parts(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 100).alias("document_id"), F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 5).cast("int")).alias("source_pages"))
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("document_id"), F.floor(F.col("p_partkey") / 100).cast("int").alias("page_number"), F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit(";;b"), F.col("p_partkey").cast("string")).alias("image_path"))
    return e, p


IMAGES = """WITH e AS (SELECT o_orderkey AS event_id, o_orderkey % 100 AS document_id, o_orderkey % 3 AS pa, o_custkey % 5 AS pb FROM orders), p AS (SELECT p_partkey % 100 AS document_id, p_partkey // 100 AS page_number, x AS image_path FROM part, unnest(['a' || p_partkey, 'b' || p_partkey]) u(x)),
    w AS (SELECT event_id, document_id, pa AS page_number FROM e UNION ALL SELECT event_id, document_id, pb FROM e), l AS (SELECT event_id, CAST(page_number AS INTEGER) AS page_number, image_path FROM w JOIN p USING (document_id, page_number)) """


def event_image_links(spark, sf_dir):
    return links.image_links(*_image_parts(spark, sf_dir))


def event_images_fallback(spark, sf_dir):
    e, p = _image_parts(spark, sf_dir)
    return links.images_or_documents(e, links.image_links(e, p), p)


def same_event_pairs(spark, sf_dir):
    return links.same_event_pairs(views.timeline_dense(spark, sf_dir))


def new_not_similar(spark, sf_dir):
    t = views.timeline_dense(spark, sf_dir)
    return links.not_yet_known(t.where(F.col("event_id") % 2 == 1), t.where(F.col("event_id") % 2 == 0)).select("case_id", "event_id")


def exact_dups(spark, sf_dir):
    t = views.timeline_dense(spark, sf_dir).withColumn("title", F.col("event_type"))
    return links.exact_duplicates(t)


def system_stats(spark, sf_dir):
    return tables.sizes({"profiles": views.profiles(spark, sf_dir), "cases": views.cases(spark, sf_dir), "documents": views.case_documents(spark, sf_dir), "errors": read(spark, sf_dir, "events").where(F.col("event_type") == "error")})


def cases_per_day(spark, sf_dir):
    return tables.per_day(read(spark, sf_dir, "events"), "ts", "2024-01-05 00:00:00")


def success_rate(spark, sf_dir):
    return tables.success_rate(views.case_documents(spark, sf_dir), ["number"])


def avg_processing(spark, sf_dir):
    w = timeline.Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("next", F.lead("ts").over(w))
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "next")})
    return tables.mean_minutes(rows, "event_type", "ts", "next")


def rating_avg(spark, sf_dir):
    rated = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rated.groupBy("source").agg(F.round(F.avg(1 + 4 * F.col("quality")), 6).alias("rating"), F.count("*").alias("n"))


def top_errors(spark, sf_dir):
    return tables.top_messages(read(spark, sf_dir, "events").where(F.col("event_type") == "error"), "props")


def active_users(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


def count_by_type(spark, sf_dir):
    return views.cases(spark, sf_dir).rollup("case_type", "status").agg(F.count("*").alias("n"))


def severity_counts(spark, sf_dir):
    found = rules.anomalies(views.timeline_sparse(spark, sf_dir))
    return found.groupBy("anomaly_type", "severity", rules.severity_rank(F.col("severity")).cast("long").alias("rank")).agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


def next_version(spark, sf_dir):
    r = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    all_cases = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    most = r.groupBy("conv_id").agg(F.max("turn").alias("_m"))
    return all_cases.join(most, "conv_id", "left").select("conv_id", (F.coalesce("_m", F.lit(0)) + 1).alias("next"))


def next_case_codes(spark, sf_dir):
    c = views.cases(spark, sf_dir).withColumn("year", F.year("updated_on"))
    old = c.where(F.col("case_id") % 4 != 0).groupBy("year").agg(F.count("*").alias("number"))
    return tables.next_codes(c.where(F.col("case_id") % 4 == 0).select(F.col("case_id").alias("id"), "year"), old, F.lit("CASO"))


def pages_grouped(spark, sf_dir):
    d = views.case_documents(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.struct("number", "document_id")))
    return d.groupBy("case_id").agg(F.array_join(F.transform(listed, lambda x: x["document_id"].cast("string")), ",").alias("documents"), F.count("*").alias("n"))


def ocr_means(spark, sf_dir):
    d = views.case_documents(spark, sf_dir).withColumn("confidence", F.when(F.col("part") % 4 != 0, F.col("pages")))
    return d.groupBy("case_id").agg(F.floor(F.avg("confidence") + 0.5).cast("long").alias("known"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("with_zero"), F.bool_or(F.col("part") % 10 == 0).alias("handwriting"))


def repeated_headers(spark, sf_dir):
    d = views.case_documents(spark, sf_dir)
    header = F.when(F.col("part") % 3 < 2, F.concat(F.lit("Intestazione "), (F.col("case_id") % 5).cast("string"))).otherwise(F.concat(F.lit("pagina "), F.col("part").cast("string")))
    return tables.repeated_edges(d.select(F.col("case_id").alias("document_id"), header.alias("header")))


def audit_page(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.col("event_type").contains("c")).select("event_id", "user_id", "event_type", "ts")
    return tables.page(e, [F.desc("ts"), F.desc("event_id")], 3)


def search_all(spark, sf_dir):
    parts = {
        "document": (read(spark, sf_dir, "documents"), "doc_id", ["text"]),
        "page": (read(spark, sf_dir, "pages").withColumn("plain", F.regexp_replace("html", "<[^>]+>", "")), "page_id", ["plain"]),
        "report": (read(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn")), "id", ["text"]),
    }
    return tables.search(parts, "(there)", 10, 25)


def dedup_key(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("key", F.concat_ws(":", "lang", F.substring("text", 1, 100)))
    by = timeline.Window.partitionBy("key").orderBy("doc_id")
    return d.withColumn("_k", F.row_number().over(by)).where(F.col("_k") == 1).select("doc_id", "lang")


def jaccard_pairs(spark, sf_dir):
    """Titles of parts of one type and size that share a word, by their first part: copies of a title are one."""
    p = read(spark, sf_dir, "part").groupBy("p_type", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("title")).agg(F.min("p_partkey").alias("part"))
    worded = p.withColumn("word", F.explode(F.array_distinct(text.long_words(F.col("title"), 3))))
    a, b = worded.select("p_type", "p_size", "word", F.col("part").alias("one"), F.col("title").alias("ta")), worded.select("p_type", "p_size", "word", F.col("part").alias("two"), F.col("title").alias("tb"))
    both = a.join(b, ["p_type", "p_size", "word"]).where(F.col("one") < F.col("two")).select("one", "two", "ta", "tb").distinct()
    return both.select("one", "two", F.round(text.jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity"))


def retention_expired(spark, sf_dir):
    return tables.expired(views.cases(spark, sf_dir), views.profiles(spark, sf_dir), AS_OF)


def cascade_remaining(spark, sf_dir):
    gone = retention_expired(spark, sf_dir)
    left = tables.many_without(views.case_documents(spark, sf_dir).select("case_id", "status"), gone, "case_id")
    return left.groupBy("status").agg(F.count("*").alias("documents"), F.countDistinct("case_id").alias("cases"))


def upsert_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    old = e.where(F.col("value") < 20).groupBy("user_id", "event_type").agg(F.min("value").alias("value"))
    new = e.where(F.col("value") >= 20)
    return tables.upsert(old, new, ["user_id", "event_type"])


def patched_events(spark, sf_dir):
    t = views.timeline_sparse(spark, sf_dir).select("event_id", "title", "description")
    patch = t.where(F.col("event_id") % 4 == 0).select("event_id", F.concat(F.lit("* "), "title").alias("title"), F.when(F.col("event_id") % 8 == 0, "nuova descrizione").alias("description"))
    return tables.patched(t, patch, "event_id")


def current_status(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    last = tables.latest(e, ["user_id"], [F.col("ts"), F.col("event_id")])
    return last.where(F.col("event_type") != "error").select("user_id", "event_type", "ts")


def share_views(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    seen = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.max("ts").alias("last"))
    return seen.withColumn("expired", F.col("last") < F.lit("2024-01-29 12:00:00").cast("timestamp"))


def confirmable(spark, sf_dir):
    wanted = views.case_documents(spark, sf_dir)
    return wanted.groupBy("case_id").agg((F.count_if(F.col("status") == "in_coda") == F.count("*")).alias("fine"), F.count("*").alias("n"))


def fk_orphans(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return tables.orphans(lines.withColumn("o_orderkey", F.col("l_orderkey")), read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 50 != 0), "o_orderkey", "o_orderkey")


def vector_topk(spark, sf_dir):
    chunks = read(spark, sf_dir, "embeddings")
    queries = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vector.nearest(chunks, queries, "vec_id", "embedding")


def vector_multi(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vector.merged(vector_topk(spark, sf_dir), texts, "vec_id", "text").select("vec_id", "similarity")


def formats(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).when(F.col("o_orderkey") % 7 == 1, F.lit("1900-01-01")).when(F.col("o_orderkey") % 7 == 2, F.lit("marzo 2020")).otherwise(day)
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return rows.select(
        "o_orderkey", dates.shown_date(shown).alias("day"), text.file_size(n).alias("size"), text.confidence_label(F.col("o_orderkey") % 101).alias("label"),
        dates.months(F.col("o_orderkey") % 400).alias("months"), dates.duration(F.col("o_orderkey") * 7).alias("lasted"),
        dates.time_ago(n).alias("ago"), text.escaped(F.concat(F.lit("<a & 'b' \"c\"> "), F.col("o_orderkey").cast("string"))).alias("xml"),
        F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 12).alias("digest"),
    )


def _all_sql():
    archived = with_views("cases", "profiles") + f", expired AS (SELECT case_id, user_id, updated_on FROM cases JOIN profiles USING (user_id) WHERE status = 'archiviato' AND retention_days IS NOT NULL AND updated_on < CAST('{AS_OF}' AS DATE) - CAST(retention_days AS INTEGER)) "
    aliases = ", ".join(f"('{a}', '{k}')" for a, k in packs.EVENT_ALIASES.items())
    types = "(" + ", ".join(f"'{x}'" for x in packs.EVENT_TYPES) + ")"
    from caseweave.plans.timelines import _RANK, anomalies_sql

    stop = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
    words = lambda x, n: f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: length(w) > {n})"
    uniq = lambda x: f"list_distinct({words(x, 3)})"
    jac = lambda a, b: f"CASE WHEN len({uniq(a)}) = 0 AND len({uniq(b)}) = 0 THEN 1.0::DOUBLE WHEN len({uniq(a)}) = 0 OR len({uniq(b)}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({uniq(a)}, {uniq(b)})) / len(list_distinct(list_concat({uniq(a)}, {uniq(b)})))::DOUBLE END"
    keys = lambda x: f"list_filter({words(x, 3)}, lambda w: w NOT IN {stop})[1:30]"
    like = lambda a, b: f"({jac(a + '.title', b + '.title')} > 0.6 OR len(list_filter({keys(a + '.description')}, lambda w: list_contains({keys(b + '.description')}, w))) >= 3)"
    docs, prof = with_views("case_documents"), with_views("profiles", "cases")
    excerpt = """CASE WHEN pos > 81 THEN '...' ELSE '' END || substring(t, CAST(greatest(pos - 81, 0) + 1 AS BIGINT), CAST(least(pos - 1 + 85, length(t)) - greatest(pos - 81, 0) AS BIGINT)) || CASE WHEN least(pos - 1 + 85, length(t)) < length(t) THEN '...' ELSE '' END"""
    return {
        "cases_by_status": with_views("cases") + "SELECT case_id, user_id, case_type FROM cases WHERE status = 'archiviato' AND case_type IN ('ortopedica', 'rc_auto') AND amount > 1000",
        "documents_in_range": docs + "SELECT document_id, updated_on FROM case_documents WHERE number BETWEEN 2 AND 4 AND updated_on >= DATE '1998-01-01' AND updated_on < DATE '1998-07-01' AND status <> 'errore'",
        "owner_visible_docs": with_views("cases", "profiles", "case_documents") + "SELECT document_id, case_id FROM case_documents WHERE case_id IN (SELECT case_id FROM cases WHERE user_id IN (SELECT user_id FROM profiles WHERE nation = 3))",
        "retryable": "SELECT event_id, props FROM events WHERE event_type = 'error' AND NOT contains(lower(props), '\"k\": 1')",
        "enum_fold": f"WITH r AS (SELECT list_extract(['surgery', 'Follow Up', 'visita', 'LAB', 'nota-spese', '??', 'diagnosis', 'pronto soccorso'], CAST(l_partkey % 8 AS INTEGER) + 1) AS raw FROM lineitem), a(alias, kind) AS (VALUES {aliases}) SELECT CASE WHEN raw IN {types} THEN raw ELSE coalesce(kind, 'altro') END AS event_type, count(*) AS n FROM r LEFT JOIN a ON a.alias = regexp_replace(lower(raw), '[\\s_-]+', '_', 'g') GROUP BY 1",
        "feature_gate": """SELECT *, NOT status IN ('canceled', 'past_due') AND ((plan IN ('pro', 'enterprise') AND status IN ('active', 'trialing')) OR feature = 'processing') AS open, count(*) AS n FROM (SELECT list_extract(['active', 'trialing', 'canceled', 'past_due', 'trial'], CAST(c_custkey % 5 AS INTEGER) + 1) AS status,
            list_extract(['pro', 'enterprise', 'trial'], CAST(c_custkey % 3 AS INTEGER) + 1) AS plan, list_extract(['processing', 'export', 'rag_guidelines', 'section_regenerate'], CAST(c_nationkey % 4 AS INTEGER) + 1) AS feature FROM customer) GROUP BY ALL""",
        "status_transitions": with_views("cases") + "SELECT old, new, new = 'archiviato' OR (old = 'archiviato' AND new = 'bozza') AS fine, count(*) AS n FROM (SELECT status AS old, lead(status) OVER (PARTITION BY user_id ORDER BY case_id) AS new FROM cases) WHERE new IS NOT NULL GROUP BY ALL",
        "docs_case_code": with_views("cases", "case_documents") + "SELECT d.document_id, d.case_id, coalesce('CASO-' || c.case_id, 'N/A') AS code FROM case_documents d LEFT JOIN (SELECT case_id FROM cases WHERE case_id % 7 <> 0) c ON c.case_id = d.case_id",
        "audit_user": with_views("profiles") + "SELECT event_id, CASE WHEN e.user_id % 10 = 0 THEN 'system' ELSE coalesce(full_name, 'N/A') END AS who FROM events e LEFT JOIN profiles p ON p.user_id = e.user_id AND p.user_id % 3 <> 0 AND e.user_id % 10 <> 0",
        "user_case_counts": prof + "SELECT p.user_id, p.plan, count(c.case_id) AS cases FROM profiles p LEFT JOIN cases c USING (user_id) GROUP BY p.user_id, p.plan",
        "doc_coverage": docs + "SELECT CASE WHEN status = 'errore' THEN 'errore' WHEN status <> 'completato' THEN 'in_attesa' WHEN n > 0 THEN 'coperto' ELSE 'senza_eventi' END AS coverage, count(*) AS n FROM (SELECT d.status, (SELECT count(*) FROM case_documents e WHERE e.document_id = d.document_id AND e.part % 3 = 0) AS n FROM case_documents d) GROUP BY 1",
        "docs_without_events": docs + "SELECT document_id FROM case_documents WHERE status = 'completato' AND document_id NOT IN (SELECT document_id FROM case_documents WHERE part % 3 = 0)",
        "event_image_links": IMAGES + "SELECT * FROM l",
        "event_images_fallback": IMAGES + "SELECT e.event_id, coalesce((SELECT nullif(count(*), 0) FROM l WHERE l.event_id = e.event_id), (SELECT count(*) FROM p WHERE p.document_id = e.document_id)) AS images, e.event_id IN (SELECT event_id FROM l) AS direct FROM e",
        "same_event_pairs": with_views("dense") + f"SELECT a.case_id, a.event_date, a.event_type, a.order_number AS order_number_a, b.order_number AS order_number_b, {like('a', 'b')} AS \"like\" FROM dense a JOIN dense b ON a.case_id = b.case_id AND a.event_date = b.event_date AND a.event_type = b.event_type AND a.order_number < b.order_number AND a.document_id <> b.document_id",
        "new_not_similar": with_views("dense") + f"SELECT case_id, event_id FROM dense n WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM dense o WHERE o.event_id % 2 = 0 AND o.case_id = n.case_id AND o.event_date = n.event_date AND o.event_type = n.event_type AND {like('n', 'o')})",
        "exact_dups": with_views("dense") + "SELECT case_id, order_number, earlier FROM (SELECT case_id, order_number, row_number() OVER (PARTITION BY case_id, event_date, event_type, description ORDER BY order_number) - 1 AS earlier FROM dense) WHERE earlier > 0",
        "system_stats": "SELECT 'profiles' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'cases', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM lineitem UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'",
        "cases_per_day": "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY 1",
        "success_rate": docs + "SELECT number, count(*) FILTER (WHERE status = 'completato') AS done, count(*) FILTER (WHERE status = 'errore') AS failed, CASE WHEN count(*) FILTER (WHERE status IN ('completato', 'errore')) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'completato') / count(*) FILTER (WHERE status IN ('completato', 'errore')), 6) ELSE 0.0::DOUBLE END AS rate FROM case_documents GROUP BY number",
        "avg_processing": "SELECT event_type, round(avg(m) FILTER (WHERE m > 0 AND m < 60), 6) AS minutes FROM (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 60e6 AS m FROM events) GROUP BY event_type",
        "rating_avg": "SELECT source, round(avg(1 + 4 * quality), 6) AS rating, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source",
        "top_errors": "SELECT substring(props, 1, 100) AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, message LIMIT 5",
        "active_users": "SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type",
        "count_by_type": with_views("cases") + "SELECT case_type, status, count(*) AS n FROM cases GROUP BY ROLLUP (case_type, status)",
        "severity_counts": f"SELECT anomaly_type, severity, CAST({_RANK} AS BIGINT) AS rank, count(*) AS n, count(DISTINCT case_id) AS cases FROM ({anomalies_sql('sparse')}) GROUP BY 1, 2, 3",
        "next_version": "SELECT conv_id, coalesce(max(turn) FILTER (WHERE role = 'assistant'), 0) + 1 AS next FROM conversations GROUP BY conv_id",
        "next_case_codes": with_views("cases") + ", old AS (SELECT year(updated_on) AS y, count(*) AS m FROM cases WHERE case_id % 4 <> 0 GROUP BY 1) SELECT case_id AS id, 'CASO-' || year(updated_on) || '-' || lpad(CAST(coalesce(m, 0) + rn AS VARCHAR), greatest(3, length(CAST(coalesce(m, 0) + rn AS VARCHAR)))::INTEGER, '0') AS code FROM (SELECT *, row_number() OVER (PARTITION BY year(updated_on) ORDER BY case_id) AS rn FROM cases WHERE case_id % 4 = 0) LEFT JOIN old ON y = year(updated_on)",
        "pages_grouped": docs + "SELECT case_id, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY number, document_id) AS documents, count(*) AS n FROM case_documents GROUP BY case_id",
        "ocr_means": docs + "SELECT case_id, CAST(floor(avg(pages) FILTER (WHERE part % 4 <> 0) + 0.5) AS BIGINT) AS known, round(avg(CASE WHEN part % 4 <> 0 THEN pages ELSE 0 END), 6) AS with_zero, bool_or(part % 10 = 0) AS handwriting FROM case_documents GROUP BY case_id",
        "repeated_headers": docs + ", h AS (SELECT case_id AS document_id, CASE WHEN part % 3 < 2 THEN 'Intestazione ' || (case_id % 5) ELSE 'pagina ' || part END AS header FROM case_documents), t AS (SELECT document_id, count(*) AS pages FROM h GROUP BY 1) SELECT h.document_id, lower(header) AS header, count(*) AS n, pages FROM h JOIN t USING (document_id) WHERE length(header) > 5 AND pages >= 3 GROUP BY h.document_id, lower(header), pages HAVING count(*) >= pages * 0.5",
        "audit_page": "WITH e AS (SELECT event_id, user_id, event_type, ts FROM events WHERE contains(event_type, 'c')) SELECT *, (SELECT count(*) FROM e) AS total, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM e) AS pages FROM e ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
        "search_all": f"""WITH d AS (SELECT 0 AS place, 'document' AS kind, doc_id AS id, regexp_replace(text, '<[^>]+>', '', 'g') AS t FROM documents WHERE contains(lower(text), 'there') ORDER BY doc_id LIMIT 10), p AS (SELECT 1 AS place, 'page' AS kind, page_id AS id, t FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages) WHERE contains(lower(t), 'there') ORDER BY page_id LIMIT 10),
            r AS (SELECT 2 AS place, 'report' AS kind, conv_id * 100 + turn AS id, regexp_replace(text, '<[^>]+>', '', 'g') AS t FROM conversations WHERE contains(lower(text), 'there') ORDER BY id LIMIT 10), b AS (SELECT *, instr(lower(t), 'there') AS pos FROM (SELECT * FROM d UNION ALL SELECT * FROM p UNION ALL SELECT * FROM r))
            SELECT kind, id, CASE WHEN pos > 0 THEN {excerpt} ELSE substring(t, 1, 160) || CASE WHEN length(t) > 160 THEN '...' ELSE '' END END AS excerpt, (SELECT count(*) FROM b) AS total FROM b ORDER BY place, id LIMIT 25""",
        "dedup_key": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY concat_ws(':', lang, substring(text, 1, 100)) ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
        "jaccard_pairs": f"WITH p AS (SELECT min(p_partkey) AS part, p_type, p_size, p_name || ' ' || p_type AS title FROM part GROUP BY ALL), s AS (SELECT a.part AS one, b.part AS two, round({jac('a.title', 'b.title')}, 6) AS similarity FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.part < b.part WHERE len(list_intersect({uniq('a.title')}, {uniq('b.title')})) > 0) SELECT * FROM s",
        "retention_expired": archived + "SELECT * FROM expired",
        "cascade_remaining": archived + f", case_documents AS ({views.SQL['case_documents']}) SELECT status, count(*) AS documents, count(DISTINCT case_id) AS cases FROM case_documents WHERE case_id NOT IN (SELECT case_id FROM expired) GROUP BY status",
        "upsert_latest": "SELECT user_id, event_type, coalesce(max(value) FILTER (WHERE value >= 20), min(value)) AS value FROM events GROUP BY user_id, event_type",
        "patched_events": with_views("sparse") + "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '* ' || title ELSE title END AS title, CASE WHEN event_id % 8 = 0 THEN 'nuova descrizione' ELSE description END AS description FROM sparse",
        "current_status": "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'",
        "share_views": "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, max(ts) AS last, max(ts) < TIMESTAMP '2024-01-29 12:00:00' AS expired FROM events GROUP BY user_id",
        "confirmable": docs + "SELECT case_id, bool_and(status = 'in_coda') AS fine, count(*) AS n FROM case_documents GROUP BY case_id",
        "fk_orphans": "SELECT count(*) AS rows, count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)) AS orphans FROM lineitem",
        "vector_topk": VECTORS + "SELECT * FROM top",
        "vector_multi": VECTORS + ", m AS (SELECT vec_id, max(similarity) AS similarity FROM top GROUP BY vec_id), k AS (SELECT vec_id, similarity, row_number() OVER (PARTITION BY substring(text, 1, 100) ORDER BY similarity DESC, vec_id) AS k FROM m JOIN documents ON doc_id = vec_id) SELECT vec_id, similarity FROM k WHERE k = 1 ORDER BY similarity DESC, vec_id LIMIT 5",
        "formats": """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '1900-01-01' WHEN 2 THEN 'marzo 2020' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, o_orderkey * o_orderkey * 37 AS n FROM orders)
            SELECT o_orderkey, CASE WHEN d = '' THEN 'Data non disponibile' WHEN d = '1900-01-01' THEN 'Data non documentata' WHEN len(string_split(d, '-')) <> 3 THEN d ELSE string_split(d, '-')[3] || '/' || string_split(d, '-')[2] || '/' || string_split(d, '-')[1] END AS day,
            CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS size, CASE WHEN o_orderkey % 101 >= 80 THEN 'alta' WHEN o_orderkey % 101 >= 50 THEN 'media' ELSE 'bassa' END AS label,
            CAST(floor(o_orderkey % 400 / 30.0 + 0.5) AS BIGINT) AS months, CASE WHEN o_orderkey * 7 < 60 THEN (o_orderkey * 7) || 's' ELSE (o_orderkey * 7 // 60) || 'm ' || (o_orderkey * 7 % 60) || 's' END AS lasted,
            CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm' WHEN n < 86400 THEN (n // 3600) || 'h' ELSE (n // 86400) || 'g' END || ' fa' AS ago, '&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt; ' || o_orderkey AS xml, substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS digest FROM r""",
    }


VECTORS = """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q WHERE vec_id <> query),
    top AS (SELECT query, vec_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity > 0.3 QUALIFY rank <= 5) """

QUERIES = {f.__name__: f for f in (
    cases_by_status, documents_in_range, owner_visible_docs, retryable, enum_fold, feature_gate, status_transitions, docs_case_code, audit_user, user_case_counts, doc_coverage, docs_without_events,
    event_image_links, event_images_fallback, same_event_pairs, new_not_similar, exact_dups, system_stats, cases_per_day, success_rate, avg_processing, rating_avg, top_errors, active_users, count_by_type,
    severity_counts, next_version, next_case_codes, pages_grouped, ocr_means, repeated_headers, audit_page, search_all, dedup_key, jaccard_pairs, retention_expired, cascade_remaining, upsert_latest,
    patched_events, current_status, share_views, confirmable, fk_orphans, vector_topk, vector_multi, formats,
)}
ORACLE_SQL = _all_sql()
