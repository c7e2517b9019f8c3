"""Queries that assemble and render reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import reports, vector_index
from caseweave.plans.texts import HEADINGS, REPORTS
from caseweave.plans.texts import reports as built
from caseweave.sources import batches, views
from caseweave.sources.shared import fresh_folder
from caseweave.sources.views import _list, read


def _drafts(spark, sf_dir):
    """Two model texts for each document: with marks, with a heading, or plain."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   ").alias("t"))
    third = F.floor(F.length("t") / 3).cast("int")
    a, b, c = (F.trim(F.substring("t", third * k + 1, third if k < 2 else F.length("t"))) for k in range(3))
    k = F.col("doc_id") % 3
    summary = F.when(k == 0, F.concat(F.lit("<!-- SECTION:RIASSUNTO -->\n"), a, F.lit("\n<!-- END:RIASSUNTO -->\n<!-- SECTION:ELEMENTI -->\n"), b, F.lit("\n<!-- END:ELEMENTI -->"))).when(k == 1, F.concat(a, F.lit("\n## Elementi di rilievo\n"), b)).otherwise(F.concat(a, F.lit(" "), b))
    chronology = F.when(k == 0, F.concat(F.lit("<!-- SECTION:CRONOLOGIA -->\n"), c, F.lit("\n<!-- END:CRONOLOGIA -->"))).otherwise(c)
    return d.select("doc_id", summary.alias("summary"), chronology.alias("chronology"))


def assembled_reports(spark, sf_dir):
    return _drafts(spark, sf_dir).select("doc_id", F.md5(reports.assembled(F.col("summary"), F.col("chronology")).cast("binary")).alias("digest"))


def numbered_reports(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    body = F.when(F.col("turn") % 4 != 3, F.concat(F.lit("testo "), F.col("turn").cast("string"))).otherwise(F.lit("  "))
    parts = c.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("place"), views.pick(HEADINGS, F.floor(F.col("turn") / 2)).alias("title"), body.alias("body"))
    return reports.with_contents(parts.dropDuplicates(["case_id", "place"]))


def named_parts(spark, sf_dir):
    return built(spark, sf_dir).select("case_id", reports.named_part(F.col("synthesis"), "danno").alias("part")).where(F.col("part") != "")


def rendered_reports(spark, sf_dir):
    return reports.rendered(built(spark, sf_dir), "case_id", "synthesis")


def guideline_ingest(spark, sf_dir):
    return reports.ingested(read(spark, sf_dir, "documents"), "doc_id", "text")


def guideline_store(spark, sf_dir):
    """The same, inserted into a store in batches of 50 and read back."""
    rows, folder = guideline_ingest(spark, sf_dir), fresh_folder(spark, "guidelines")
    batches.insert(rows, folder)
    return batches.inserted(spark, folder, rows.schema)


def vector_approximate(spark, sf_dir):
    chunks = read(spark, sf_dir, "embeddings")
    queries = chunks.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return reports.approximate_nearest(chunks, queries, "vec_id", "embedding")


def vector_inverted(spark, sf_dir):
    """The same by an inverted file over all vectors, written to the shared folder and read again."""
    chunks, folder = read(spark, sf_dir, "embeddings"), fresh_folder(spark, "inverted")
    vector_index.build(chunks, "vec_id", "embedding", folder)
    queries = chunks.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vector_index.search(spark, folder, queries, chunks, "vec_id", "embedding")


QUERIES = {f.__name__: f for f in (assembled_reports, numbered_reports, named_parts, rendered_reports, guideline_ingest, guideline_store, vector_approximate, vector_inverted)}
ORACLE_SQL = {
    "assembled_reports": """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   ') AS t FROM documents), p AS (SELECT doc_id, trim(substring(t, 1, length(t) // 3)) AS a, trim(substring(t, length(t) // 3 + 1, length(t) // 3)) AS b, trim(substring(t, length(t) // 3 * 2 + 1)) AS c FROM d),
        h AS (SELECT *, chr(10) AS n, chr(10) || chr(10) AS nn, '## Elementi di rilievo' || chr(10) || b AS e FROM p)
        SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 AND length(a) > 50 AND length(b) > 50 AND length(c) > 50 THEN a || nn || c || nn || b
            WHEN doc_id % 3 = 0 THEN '<!-- SECTION:RIASSUNTO -->' || n || a || n || '<!-- END:RIASSUNTO -->' || n || '<!-- SECTION:ELEMENTI -->' || n || b || n || '<!-- END:ELEMENTI -->' || nn || '<!-- SECTION:CRONOLOGIA -->' || n || c || n || '<!-- END:CRONOLOGIA -->'
            WHEN doc_id % 3 = 1 AND length(a) > 100 AND length(trim(e, ' ' || n)) > 100 THEN a || nn || c || nn || e WHEN doc_id % 3 = 1 THEN trim(a || n || e, ' ' || n) || nn || c
            ELSE trim(a || ' ' || b) || nn || c END) AS digest FROM h""",
    "numbered_reports": f"""WITH c AS (SELECT DISTINCT conv_id AS case_id, turn, list_extract({_list(HEADINGS)}, CAST((turn // 2) % 5 AS INTEGER) + 1) AS title FROM conversations WHERE role = 'assistant' AND turn % 4 <> 3), n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn) AS n FROM c)
        SELECT case_id, '# Indice' || chr(10) || chr(10) || string_agg(n || '. ' || title, chr(10) ORDER BY n) || chr(10) || chr(10) || string_agg('## ' || n || '. ' || title || chr(10) || chr(10) || 'testo ' || turn, chr(10) || chr(10) ORDER BY n) AS report FROM n GROUP BY case_id""",
    "named_parts": f"WITH {REPORTS} SELECT * FROM (SELECT case_id, trim(regexp_extract(string_split(chr(10) || synthesis, chr(10) || '## Danno biologico' || chr(10))[2], '(?s)^(.*?)(?:\\n## |$)', 1)) AS part FROM reports WHERE contains(synthesis, '## Danno biologico')) WHERE part <> ''",
}
