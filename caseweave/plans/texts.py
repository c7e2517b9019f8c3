"""Queries over texts, files and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.functions import text
from caseweave.operators import intervals, pii, tables, texts, timeline
from caseweave.sources import files, views
from caseweave.sources.views import _list, read, with_views
from caseweave.streaming import gates, limits

HEADINGS = ["Riassunto del caso", "Cronologia medico-legale", "Danno biologico", "Elementi di rilievo", "Àltro tema, 2"]


def reports(spark, sf_dir):
    """A report of each conversation: its assistant's turns under headings, with references and dates."""
    c = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    body = F.concat(F.lit("## "), views.pick(HEADINGS, F.floor(F.col("turn") / 2)), F.lit("\n"), "text", F.lit(" [Ev."), (F.col("turn") * 3).cast("string"), F.lit("] "), F.when(F.col("conv_id") % 5 == 0, "01/01/1900").otherwise("03/10/1998"))
    listed = F.array_sort(F.collect_list(F.struct("turn", body.alias("body"))))
    return c.groupBy(F.col("conv_id").alias("case_id")).agg(F.concat_ws("\n", F.transform(listed, lambda x: x["body"])).alias("synthesis"))


REPORTS = f"""reports AS (SELECT conv_id AS case_id, string_agg('## ' || list_extract({_list(HEADINGS)}, CAST((turn // 2) % 5 AS INTEGER) + 1) || chr(10) || text || ' [Ev.' || (turn * 3) || '] ' || CASE WHEN conv_id % 5 = 0 THEN '01/01/1900' ELSE '03/10/1998' END, chr(10) ORDER BY turn, text) AS synthesis FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"""


def report_sections(spark, sf_dir):
    return texts.sections(reports(spark, sf_dir), "case_id", "synthesis")


def report_qa(spark, sf_dir):
    return texts.report_issues(reports(spark, sf_dir), views.timeline_sparse(spark, sf_dir).select("case_id", "order_number", "event_date"))


def latest_report(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return tables.latest(c.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest")), ["conv_id"], [F.col("turn"), F.col("digest")])


def section_event_links(spark, sf_dir):
    from caseweave.operators.links import section_links

    t = views.timeline_sparse(spark, sf_dir).select("case_id", "order_number", "event_date", "title")
    s = report_sections(spark, sf_dir).select("case_id", F.col("place").alias("section"), "content")
    return section_links(s, t)


def dup_blocks(spark, sf_dir):
    return texts.repeated_blocks(read(spark, sf_dir, "documents"), "doc_id", "text")


def text_scalars(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", F.size(text.text_words(t)).cast("long").alias("words"), text.token_estimate(t).alias("tokens"), text.ocr_confidence(t).alias("ocr_confidence"), text.slug(F.substring_index(t, "\n", 1)).alias("slug"), texts.is_truncated(t).alias("truncated"))


def pii_matches(spark, sf_dir):
    phone, email = pii.PASSES[9][1], "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
    d = read(spark, sf_dir, "documents")
    found = d.select("doc_id", F.regexp_count("text", F.lit(phone)).cast("long").alias("phones"), F.regexp_count("text", F.lit(email)).cast("long").alias("emails"))
    return found.where((F.col("phones") > 0) | (F.col("emails") > 0))


def pii_mask(spark, sf_dir):
    return pii.masked(pii.detected(read(spark, sf_dir, "documents").select("doc_id", "text")))


def pii_counts(spark, sf_dir):
    return pii.counts(pii.detected(read(spark, sf_dir, "documents").select("doc_id", "text")))


def text_chunks(spark, sf_dir):
    return texts.chunks(read(spark, sf_dir, "documents"), "doc_id", "text")


def table_blocks(spark, sf_dir):
    return texts.table_counts(read(spark, sf_dir, "documents"), "doc_id", "text")


def _quotes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    q = d.select("doc_id", "text", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("quote_id"))
    piece = F.substring("text", 1, 0)
    for k, (a, n) in enumerate(((1, 90), (61, 90), (301, 120), (1001, 400))):
        cut = F.substring("text", a, n)
        piece = F.when(F.col("quote_id") == k, F.upper(cut) if k == 2 else cut).otherwise(piece)
    return d, q.select("doc_id", "quote_id", piece.alias("quote"))


def text_coverage(spark, sf_dir):
    d, q = _quotes(spark, sf_dir)
    union = intervals.merged(texts.located(q, d))
    covered = union.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    n = F.length(texts.stripped(F.col("text")))
    return d.join(covered, "doc_id", "left").select("doc_id", F.when(n == 0, 100).otherwise(F.floor(100.0 * F.coalesce("covered", F.lit(0)) / n + 0.5)).cast("long").alias("percent"))


def provenance(spark, sf_dir):
    d, q = _quotes(spark, sf_dir)
    shifted = q.withColumn("quote", F.when(F.col("quote_id") == 3, F.regexp_replace("quote", r"\s\S+\s(\S+\s\S+\s\S+\s\S+\s\S+\s\S+)", " $1")).otherwise(F.col("quote")))
    return texts.provenance(shifted, d)


def event_validation(spark, sf_dir):
    t = views.timeline_dense(spark, sf_dir).withColumn("title", F.col("event_type"))
    return texts.event_issues(t, "2024-01-20")


def _spans(spark, sf_dir):
    start = (F.col("l_partkey") % 1000).cast("long")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2000).alias("doc_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


SPANS = "spans AS (SELECT l_orderkey % 2000 AS doc_id, l_partkey % 1000 AS s, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN coalesce(s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) THEN 1 ELSE 0 END AS fresh FROM spans)), un AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM isl GROUP BY doc_id, g)"


def interval_merge(spark, sf_dir):
    return intervals.merged(_spans(spark, sf_dir))


def uncovered_blocks(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return intervals.uncovered(intervals.merged(spans), spans.select("doc_id", F.lit(1200).cast("long").alias("length")).distinct(), 60)


def greedy_spans(spark, sf_dir):
    grouped = _spans(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kept = grouped.select("doc_id", intervals.greedy(F.col("spans")).alias("k"))
    return kept.select("doc_id", F.size("k").cast("long").alias("kept"), F.aggregate("k", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("length"))


def chunk_ranges(spark, sf_dir):
    docs = views.case_documents(spark, sf_dir).select("document_id", F.col("pages").cast("int").alias("n_pages"))
    return timeline.page_chunks(docs)


def page_windows(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 30).alias("document_id"), F.col("page_id").alias("page_number"), F.coalesce("html", F.lit("")).alias("ocr_text"))
    return texts.page_windows(p)


def csv_rows(spark, sf_dir):
    t = views.timeline_sparse(spark, sf_dir)
    none = F.lit(None).cast("string")
    extra = {"date_precision": F.lit("giorno"), "source_type": F.lit("altro"), "doctor": none, "facility": F.when(F.col("event_id") % 9 == 0, 'Clinica "A"; B'), "confidence": F.col("event_id") % 101, "requires_verification": F.col("event_id") % 2 == 0}
    return files.csv_lines(t.withColumns(extra))


def filing_xml(spark, sf_dir):
    c = views.cases(spark, sf_dir)
    return files.filing_xml(c.select("case_id", F.concat("case_type", F.lit(" & <x>")).alias("oggetto"), F.when(F.col("case_id") % 3 != 0, F.col("status")).alias("stato")))


def subject_access(spark, sf_dir):
    c = views.cases(spark, sf_dir).select("user_id", F.col("updated_on").alias("at"), "case_id", "status")
    return files.subject_access(views.profiles(spark, sf_dir).select("user_id", "plan"), {"cases": c, "audit": c.select("user_id", "at", "case_id")})


def demo_case(spark, sf_dir):
    codes = read(spark, sf_dir, "region").select(F.concat(F.lit("CASO-"), "r_name").alias("code"))
    return files.demo_cases(spark, codes)


def gate_timeout(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    asked = e.where(F.col("event_type") == "error").select(F.col("user_id").alias("case_id"), F.col("ts").alias("requested"))
    answers = e.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("case_id"), F.col("ts").alias("confirmed"))
    return gates.gate(asked, answers)


def sliding_rate(spark, sf_dir):
    return limits.sliding(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 3600, 1).select("event_id", "recent", "allowed")


def fixed_rate(spark, sf_dir):
    return limits.fixed(read(spark, sf_dir, "events"), 7200, 1)


def subscription_state(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = views.pick(["checkout", "updated", "deleted", "failed", "other"], F.col("event_id"))
    return gates.subscriptions(e.select("user_id", kind.alias("kind"), F.col("ts").alias("at"), "event_id"))


WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
_PARTS = f"{REPORTS}, parts AS (SELECT case_id, p - 2 AS place, list_extract(l, p) AS part FROM (SELECT case_id, string_split(chr(10) || synthesis, chr(10) || '## ') AS l FROM reports), LATERAL unnest(generate_series(2, len(l))) u(p)), secs AS (SELECT case_id, CAST(place AS INTEGER) AS place, trim(regexp_extract(part, '^[^\\n]*')) AS title, regexp_replace(CASE WHEN instr(part, chr(10)) > 0 THEN substring(part, instr(part, chr(10)) + 1) ELSE '' END, '^\\s+|\\s+$', '', 'g') AS content FROM parts)"


def _section_sql(title: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({title}, '(?i){p}') THEN '{n}'" for p, n in text.SECTION_IDS)
    return f"CASE {cases} ELSE substring(regexp_replace(regexp_replace(lower({title}), '[^a-zà-ú0-9\\s]', '', 'g'), '\\s+', '_', 'g'), 1, 40) END"


def _qa_sql() -> str:
    words = "len(list_filter(string_split_regex(synthesis, '\\s+'), lambda w: w <> ''))"
    refs = "list_distinct(list_transform(regexp_extract_all(synthesis, '\\[Ev\\.(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)))"
    parts = [f"SELECT case_id, 'too_short' AS issue, 'error' AS severity, CAST({words} AS VARCHAR) AS detail FROM r WHERE {words} < 200"]
    parts += [f"SELECT case_id, 'missing_section', 'error', '{n}' FROM r WHERE NOT regexp_matches(synthesis, '(?i){p}')" for n, p in texts.REQUIRED]
    parts += [f"SELECT case_id, 'sentinel_date', 'warning', '{k}' FROM r WHERE regexp_matches(synthesis, '{p}')" for k, p in enumerate(texts.SENTINELS)]
    parts.append(f"SELECT case_id, 'low_coverage', 'warning', CAST(CAST(floor(100.0 * len({refs}) / n + 0.5) AS BIGINT) AS VARCHAR) FROM r WHERE n > 0 AND 100.0 * len({refs}) / n < 50")
    parts.append(f"SELECT case_id, 'invalid_reference', 'error', CAST(x AS VARCHAR) FROM (SELECT case_id, n, unnest({refs}) AS x FROM r) WHERE x <= 0 OR x > n")
    parts.append("SELECT case_id, 'phantom_date', 'warning', d FROM (SELECT case_id, n, unnest(list_distinct(regexp_extract_all(synthesis, '\\b(\\d{2}/\\d{2}/\\d{4})\\b', 1))) AS d FROM r) q WHERE n > 0 AND right(d, 5) <> '/1900' AND NOT EXISTS (SELECT 1 FROM sparse s WHERE s.case_id = q.case_id AND strftime(event_date, '%d/%m/%Y') = d)")
    blocks = _blocks_sql("case_id", "(SELECT case_id, synthesis AS text FROM reports)")
    parts.append(f"SELECT case_id, 'duplicate_content', CASE WHEN times >= 3 THEN 'error' ELSE 'warning' END, CAST(times AS VARCHAR) FROM ({blocks})")
    return with_views("sparse") + f", {REPORTS}, r AS (SELECT case_id, synthesis, (SELECT count(*) FROM sparse s WHERE s.case_id = x.case_id) AS n FROM reports x) " + " UNION ALL ".join(parts)


def _blocks_sql(key: str, source: str) -> str:
    return f"""SELECT {key}, arg_min(times, first) AS times FROM (SELECT {key}, block, count(*) AS times, min(i) AS first FROM (SELECT {key}, i, array_to_string(w[i:i + 49], ' ') AS block FROM (SELECT {key}, {WORDS} AS w FROM {source}), LATERAL unnest(generate_series(1, len(w) - 49, 10)) u(i) WHERE len(w) >= 100) GROUP BY {key}, block HAVING count(*) > 1) GROUP BY {key}"""


def _tables_sql() -> str:
    pattern = "array_to_string(list_transform(string_split_regex(trim(l), '\\s+'), lambda t: CASE WHEN regexp_full_match(t, '\\d+[.,]?\\d*') THEN 'N' WHEN regexp_matches(t, '^[A-Za-zÀ-ÿ]') THEN 'W' ELSE 'P' END), ' ')"
    line = "CASE WHEN regexp_matches(trim(l), '" + texts.NUMERIC_LINE + "') THEN 1 ELSE 0 END"
    return f"""WITH b AS (SELECT doc_id, text, unnest(list_filter(string_split_regex(text, '\\n{{2,}}'), lambda b: trim(b) <> '')) AS block, generate_subscripts(list_filter(string_split_regex(text, '\\n{{2,}}'), lambda b: trim(b) <> ''), 1) AS k FROM documents WHERE length(text) >= 30),
        f AS (SELECT doc_id, k, count(*) AS n, count(*) FILTER (WHERE length(l) - length(replace(l, '|', '')) >= 2) AS pipes, bool_or(regexp_matches(l, '{texts.SEPARATOR}')) AS sep, sum({line}) AS num FROM (SELECT doc_id, k, unnest(string_split(block, chr(10))) AS l FROM b) WHERE trim(l) <> '' GROUP BY doc_id, k),
        m AS (SELECT doc_id, k, max(c) AS most FROM (SELECT doc_id, k, {pattern} AS p, count(*) AS c FROM (SELECT doc_id, k, unnest(string_split(block, chr(10))) AS l FROM b) WHERE trim(l) <> '' GROUP BY doc_id, k, p) GROUP BY doc_id, k)
        SELECT d.doc_id, count(*) FILTER (WHERE f.n >= 3 AND (pipes >= 3 OR (sep AND pipes >= 2) OR num >= 3 OR most >= 4)) AS tables FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN m ON m.doc_id = f.doc_id AND m.k = f.k GROUP BY d.doc_id"""


QUERIES = {f.__name__: f for f in (
    report_sections, report_qa, latest_report, section_event_links, dup_blocks, text_scalars, pii_matches, pii_mask, pii_counts, text_chunks, table_blocks, text_coverage, provenance, event_validation,
    interval_merge, uncovered_blocks, greedy_spans, chunk_ranges, page_windows, csv_rows, filing_xml, subject_access, demo_case, gate_timeout, sliding_rate, fixed_rate, subscription_state,
)}
ORACLE_SQL = {
    "report_sections": f"WITH {_PARTS} SELECT case_id, place, {_section_sql('title')} AS section_id, title, content FROM secs",
    "report_qa": _qa_sql(),
    "latest_report": "SELECT conv_id, turn, digest FROM (SELECT conv_id, turn, md5(text) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, md5(text) DESC) AS k FROM conversations WHERE role = 'assistant') WHERE k = 1",
    "section_event_links": with_views("sparse") + f""", {_PARTS}, l AS (SELECT s.case_id, s.place AS section, t.order_number, 1 AS r FROM secs s JOIN sparse t ON t.case_id = s.case_id AND contains(content, '[Ev.' || t.order_number || ']')
        UNION ALL SELECT s.case_id, s.place, t.order_number, 2 FROM secs s JOIN sparse t ON t.case_id = s.case_id AND contains(replace(content, '.', '/'), strftime(event_date, '%d/%m/%Y')) UNION ALL SELECT s.case_id, s.place, t.order_number, 3 FROM secs s JOIN sparse t ON t.case_id = s.case_id AND len(string_split_regex(title_of(t), '\\s+')) >= 4 AND FALSE)
        SELECT case_id, section, order_number, CASE min(r) WHEN 1 THEN 'explicit' WHEN 2 THEN 'date' ELSE 'title' END AS kind, CASE min(r) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM l GROUP BY case_id, section, order_number""".replace(" UNION ALL SELECT s.case_id, s.place, t.order_number, 3 FROM secs s JOIN sparse t ON t.case_id = s.case_id AND len(string_split_regex(title_of(t), '\\s+')) >= 4 AND FALSE", " UNION ALL SELECT s.case_id, s.place, t.order_number, 3 FROM secs s JOIN sparse t ON t.case_id = s.case_id AND len(string_split_regex(t.title, '\\s+')) >= 4 AND contains(lower(content), lower(t.title))"),
    "dup_blocks": _blocks_sql("doc_id", "documents"),
    "text_scalars": f"""SELECT doc_id, len({WORDS}) AS words, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(CASE WHEN length(text) < 10 THEN 0 ELSE greatest(least(floor(90 - least(5 * len(regexp_extract_all(lower(text), '\\[illeggibile\\]')), 40) + least(len(string_split_regex(text, '\\s+')) / 10.0, 10.0) + 0.5), 100), 10) END AS BIGINT) AS ocr_confidence,
        substring(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-zà-ú0-9\\s]', '', 'g'), '\\s+', '_', 'g'), 1, 40) AS slug,
        NOT regexp_matches(text, '(?i)conclusion|in fede|il consulente|firma') AND NOT starts_with(trim(last), '#') AND NOT list_contains(['.', '!', '?', ')', ']', '*', '|', ':', ';', '"'], right(trim(last), 1)) AS truncated FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-1] AS last FROM documents)""",
    "pii_matches": "SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '" + pii.PASSES[9][1] + "')) AS phones, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails FROM documents) WHERE phones > 0 OR emails > 0",
    "table_blocks": _tables_sql(),
    "event_validation": with_views("dense") + """, t AS (SELECT * REPLACE (event_type AS title) FROM dense) SELECT case_id, order_number, 'future_date' AS issue, CAST(1 AS BIGINT) AS times FROM t WHERE event_date > DATE '2024-01-20' UNION ALL SELECT case_id, order_number, 'short_description', 1 FROM t WHERE length(description) < 20
        UNION ALL SELECT b.case_id, b.order_number, 'duplicate', count(*) FROM t a JOIN t b ON a.case_id = b.case_id AND a.event_date = b.event_date AND a.title = b.title AND a.description = b.description AND a.order_number < b.order_number GROUP BY b.case_id, b.order_number""",
    "interval_merge": f"WITH {SPANS} SELECT doc_id, s AS start, e AS \"end\" FROM un",
    "uncovered_blocks": f"WITH {SPANS}, g AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM un UNION ALL SELECT doc_id, max(e), 1200 FROM un GROUP BY doc_id) SELECT doc_id, a AS start, b AS \"end\" FROM g WHERE b - a >= 60",
    "chunk_ranges": with_views("case_documents") + "SELECT document_id, CAST((p - 1) // 10 AS INTEGER) AS chunk, CAST(p AS INTEGER) AS first_page, CAST(least(p + 9, pages) AS INTEGER) AS last_page FROM case_documents, LATERAL unnest(generate_series(1, CAST(pages AS INTEGER), 10)) u(p)",
    "csv_rows": with_views("sparse") + """SELECT case_id, order_number, concat_ws(';', CAST(order_number AS VARCHAR), strftime(event_date, '%d/%m/%Y'), 'giorno', event_type, title, description, 'altro', coalesce(diagnosis, ''), '', CASE WHEN event_id % 9 = 0 THEN '"Clinica ""A""; B"' ELSE '' END, CAST(event_id % 101 AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN 'Si' ELSE 'No' END) AS line FROM sparse""",
    "filing_xml": with_views("cases") + "SELECT case_id, '<deposito><oggetto>' || case_type || ' &amp; &lt;x&gt;</oggetto>' || CASE WHEN case_id % 3 <> 0 THEN '<stato>' || status || '</stato>' ELSE '' END || '</deposito>' AS xml FROM cases",
    "demo_case": "SELECT 'DEMO-001' AS code, 'M.R.' AS patient_initials, 'ortopedica' AS case_type, 'bozza' AS status WHERE NOT EXISTS (SELECT 1 FROM region WHERE starts_with('CASO-' || r_name, 'DEMO-'))",
    "gate_timeout": "SELECT a.user_id AS case_id, a.ts AS requested, min(b.ts) AS confirmed FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 7 DAY WHERE a.event_type = 'error' GROUP BY a.user_id, a.ts",
    "sliding_rate": "SELECT a.event_id, count(*) AS recent, count(*) <= 1 AS allowed FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts <= a.ts AND epoch_us(b.ts) > epoch_us(a.ts) - 3600000000 GROUP BY a.event_id",
    "fixed_rate": """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
        w AS (SELECT user_id, k, t AS opened, 1::BIGINT AS used, 1::BIGINT AS allowed, 0::BIGINT AS refused FROM r WHERE k = 1 UNION ALL SELECT user_id, k, CASE WHEN fresh THEN t ELSE opened END, CASE WHEN fresh THEN 1 ELSE used END, allowed + CASE WHEN fresh THEN 1 ELSE 0 END, refused + CASE WHEN fresh THEN 0 ELSE 1 END
            FROM (SELECT w.user_id, r.k, r.t, opened, used, allowed, refused, r.t - opened >= 7200000000 AS fresh FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1))
        SELECT user_id, allowed, refused FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS l FROM w) WHERE l = 1""",
    "greedy_spans": f"""{f"WITH {SPANS}".replace("WITH", "WITH RECURSIVE", 1)}, o AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC) AS k FROM spans),
        g AS (SELECT doc_id, k, e AS last, 1::BIGINT AS kept, CAST(e - s AS BIGINT) AS length FROM o WHERE k = 1 UNION ALL
            SELECT g.doc_id, o.k, CASE WHEN o.s >= last THEN o.e ELSE last END, kept + CASE WHEN o.s >= last THEN 1 ELSE 0 END, length + CASE WHEN o.s >= last THEN o.e - o.s ELSE 0 END FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1)
        SELECT doc_id, kept, length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS l FROM g) WHERE l = 1""",
    "subject_access": with_views("cases", "profiles") + """, c AS (SELECT user_id, updated_on AS day, '{"case_id":' || case_id || coalesce(',"status":"' || status || '"', '') || '}' AS r, '{"case_id":' || case_id || '}' AS q FROM cases), listed AS (SELECT user_id, string_agg(r, ',' ORDER BY day DESC, r DESC) AS cases FROM c GROUP BY user_id),
        last AS (SELECT user_id, string_agg(q, ',' ORDER BY day DESC, q DESC) AS audit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, q DESC) AS k FROM c) WHERE k <= 500 GROUP BY user_id)
        SELECT p.user_id, '{"profile":{' || coalesce('"plan":"' || plan || '"', '') || '},"cases":[' || coalesce(cases, '') || '],"audit":[' || coalesce(audit, '') || ']}' AS json FROM profiles p LEFT JOIN listed USING (user_id) LEFT JOIN last USING (user_id)""",
    "subscription_state": "SELECT user_id, arg_max(status, (ts, event_id)) AS status FROM (SELECT *, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'canceled' WHEN 3 THEN 'past_due' END AS status FROM events) WHERE status IS NOT NULL GROUP BY user_id",
}
