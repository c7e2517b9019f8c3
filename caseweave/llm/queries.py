"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import conversations, decontaminate, html_extract, hyperminhash, language_id, media, packing, simhash, substring_dedup, token_counts, token_store, url_filter, whitening
from caseweave.llm.common import shared_dir
from caseweave.shipping import importable

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_OF_TEXT = 49407


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by a separator scan of flat token files."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE, END_OF_TEXT)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove passages of 20 words and more that also start earlier in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, width=20, columns=["doc_id"])


#: The policy of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs; a labelled page is bad if it is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, 2048, 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those that are not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links at 4 bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as rANS token files and read them back."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), WORD_BPE, 2, path)
    return token_store.read(spark, path)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document's text as a medium, refer to it from a page, and join both by digest."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"]
    return media.text_media(table(spark, sf_dir, "documents")).select(*names)


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ordered texts and media: the document of a page's number stands below its title as a figure, referred to by digest and joined from the store."""
    store = media.store_texts(table(spark, sf_dir, "documents"))
    owned = store.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("digest").alias("_d"))
    figure = F.concat(F.lit('</h1><figure><img src="sha256:'), "_d", F.lit('" alt="scan"><figcaption>Document '), F.col("page_id").cast("string"), F.lit("</figcaption></figure>"))
    pages = table(spark, sf_dir, "pages").join(owned, "page_id", "left")
    html = F.when(F.col("_d").isNotNull(), F.replace(F.col("html"), F.lit("</h1>"), figure)).otherwise(F.col("html"))
    found = media.resolve(media.interleave(pages.select("page_id", html.alias("html"))), media.store_facts(store), pages.count())
    return found.select("page_id", "position", "kind", "text", "ref", "caption", "payload_bytes", "payload_sha256", "feature")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents whose sets of three-word shingles are 0.85 or more similar."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations, then repair them by the cheapest edits."""
    given = table(spark, sf_dir, "conversations")
    return conversations.repairs(conversations.damage(given), given)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


QUERIES = {"op1_html_extraction": op1_html_extraction, "op2_token_counts": op2_token_counts, "op3_decontamination": op3_decontamination, "op4_substring_dedup": op4_substring_dedup, "op5_url_filter": op5_url_filter, "op6_best_fit_packing": op6_best_fit_packing, "op7_language_id": op7_language_id, "op8_simhash_near_dedup": op8_simhash_near_dedup, "op9_token_files": op9_token_files, "op10_media_columns": op10_media_columns, "page_media": page_media, "op11_minhash_near_dedup": op11_minhash_near_dedup, "op12_conversation_repair": op12_conversation_repair, "op13_embedding_whitening": op13_embedding_whitening}

#: Words, windows of 20 of them, those that also start earlier, and what is left of each document.
REPEATS_SQL = """WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
    places AS (SELECT doc_id, words, i FROM split, LATERAL unnest(generate_series(1, len(words))) u(i)),
    windows AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS text FROM places),
    starts AS (SELECT doc_id, i, word, text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id, i) > 1 AS again FROM windows),
    covered AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM starts)
    SELECT s.doc_id, len(any_value(words)) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id GROUP BY s.doc_id"""


def _shrunk_sql(name: str, source: str, mean: str) -> str:
    """Two steps: the strength of a level, then each group's posterior mean and size."""
    spread = f"{mean} * (1 - {mean})"
    rho = f"greatest(0.001, least(0.9, coalesce(CASE WHEN sum(n * (n - 1) * {spread}) > 0 THEN sum((k - n * {mean}) * (k - n * {mean}) - n * {spread}) / sum(n * (n - 1) * {spread}) END, 0.001)))::DOUBLE"
    return f"{name}_rho AS (SELECT {rho} AS rho FROM {source}), {name} AS (SELECT *, ({mean} * (1 - rho) / rho + k) / ((1 - rho) / rho + n) AS {name}_mean, (1 - rho) / rho + n AS {name}_size FROM {source}, {name}_rho)"


def _url_sql() -> str:
    second = ", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in rules) + " END"
    return f"""WITH rest AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        marked AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
        counted AS (SELECT host, coalesce(sum(bad), 0)::DOUBLE AS k, count(bad)::DOUBLE AS n, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', ''), '.') AS l FROM parts LEFT JOIN marked ON doc_id = page_id GROUP BY host),
        sized AS (SELECT *, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 2 ELSE 1 END AS z FROM counted),
        hosts AS (SELECT host, k, n, array_to_string(l[greatest(len(l) - z, 1):], '.') AS domain, array_to_string(l[greatest(len(l) - z + 1, 1):], '.') AS suffix FROM sized),
        domains AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n FROM hosts GROUP BY ALL), whole AS (SELECT coalesce((sum(k) + 1) / (sum(n) + 2), 0.5) AS m0 FROM domains),
        suffixes AS (SELECT suffix, sum(k) AS k, sum(n) AS n, any_value(m0) AS m0 FROM domains, whole GROUP BY suffix), {_shrunk_sql('s', 'suffixes', 'm0')},
        with_suffix AS (SELECT d.*, s_mean FROM domains d JOIN s USING (suffix)), {_shrunk_sql('d', 'with_suffix', 's_mean')},
        with_domain AS (SELECT h.*, d_mean FROM hosts h JOIN d USING (domain, suffix)), {_shrunk_sql('h', 'with_domain', 'd_mean')}
        SELECT page_id, host, path, {fits(lambda v, h, p: h + p)} AS rule, coalesce({fits(lambda v, h, p: v)}, CASE WHEN h_mean - sqrt(h_mean * (1 - h_mean) / (h_size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM parts JOIN h USING (host)"""


#: Sets of shingles, one node for each; links by what two sets share; the nodes that each node reaches.
NEAR_SQL = f"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM split),
    nodes AS (SELECT s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s), items AS (SELECT node, len(s) AS n, unnest(s) AS x FROM nodes),
    pairs AS (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT node, node AS r FROM nodes UNION SELECT node, links.b FROM reach JOIN links ON links.a = r),
    least_of AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
    SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN least_of USING (node)"""

ORACLE_SQL: dict[str, str] = {"op11_minhash_near_dedup": NEAR_SQL, "op4_substring_dedup": REPEATS_SQL, "op5_url_filter": _url_sql()}
