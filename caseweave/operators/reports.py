"""Reports: named parts of model texts, assembly with numbers and contents, rendering to HTML, ingestion of guidelines."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.text import trimmed
from caseweave.operators.texts import chunks
from caseweave.operators.vector import nearest, usable

#: Headings that open the part on relevant elements, in order (fixed patterns).
ELEMENTS = [r"^#{1,3}\s*(?:\d+[.)]\s*)?(?:SEZIONE\s*\d*\s*[—–-]\s*)?ELEMENTI\s+DI\s+RILIEVO", r"^#{1,3}\s*ASPETTI\s+(?:CRITICI|RILEVANTI)\s+MEDICO", r"^#{1,3}\s*ANALISI\s+MEDICO[—–\s-]*LEGALE", r"^#{1,3}\s*OSSERVAZIONI\s+MEDICO", r"^#{1,3}\s*CRITICITÀ"]


def marked_part(text: Column, name: str) -> Column:
    """What stands between the marks of a part, trimmed; empty if it isn't there."""
    return trimmed(F.regexp_extract(text, rf"(?s)<!-- SECTION:{name} -->\s*(.*?)\s*<!-- END:{name} -->", 1))


def assembled(summary: Column, chronology: Column) -> Column:
    """One report of two texts: by marks if all three parts are over 50 characters; else cut at the heading of the elements if both sides are over 100; else one after the other."""
    parts = [marked_part(summary, "RIASSUNTO"), marked_part(chronology, "CRONOLOGIA"), marked_part(summary, "ELEMENTI")]
    marked = (F.length(parts[0]) > 50) & (F.length(parts[1]) > 50) & (F.length(parts[2]) > 50)
    whole = F.concat_ws("\n\n", trimmed(summary), trimmed(chronology))
    for pattern in reversed(ELEMENTS):
        at = F.regexp_instr(summary, F.lit("(?im)" + pattern))
        head, tail = trimmed(F.substring(summary, F.lit(1), at - 1)), trimmed(F.substring(summary, at, F.length(summary)))
        whole = F.when((at > 0) & (F.length(head) > 100) & (F.length(tail) > 100), F.concat_ws("\n\n", head, trimmed(chronology), tail)).otherwise(whole)
    return F.when(marked, F.concat_ws("\n\n", *parts)).otherwise(whole)


def without_marks(report: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(report, r"<!-- (?:SECTION|END):\w+ -->\n?", ""), r"\n{3,}", "\n\n")


def named_part(text: Column, heading: str) -> Column:
    """The text below the first heading of up to two # that holds `heading` (a pattern, any case), up to the next such heading."""
    return trimmed(F.regexp_extract(F.concat(F.lit("\n"), text), rf"(?is)\n#{{1,2}}[ \t][^\n]*{heading}[^\n]*\n(.*?)(?=\n#{{1,2}}[ \t]|\z)", 1))


def with_contents(parts: DataFrame) -> DataFrame:
    """case_id and the report of its parts (case_id, place, title, body): parts without a body are left out, the rest is numbered in order below a table of contents."""
    kept = parts.where(trimmed(F.coalesce("body", F.lit(""))) != "")
    rows = kept.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("place", "title")))
    listed = F.array_sort(F.collect_list(F.struct("n", "title", trimmed(F.col("body")).alias("body"))))
    grouped = rows.groupBy("case_id").agg(listed.alias("p"))
    line = lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["title"])
    contents = F.array_join(F.transform("p", line), "\n")
    bodies = F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), line(x), F.lit("\n\n"), x["body"])), "\n\n")
    return grouped.select("case_id", F.concat(F.lit("# Indice\n\n"), contents, F.lit("\n\n"), bodies).alias("report"))


def _inline(text: str) -> str:
    out = html.escape(text, quote=True)
    out = re.sub(r"!\[([^\]]*)\]\((https?://[^\s)]+|/[^\s)]*)\)", r'<img src="\2" alt="\1">', out)
    out = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", out)
    return re.sub(r"\*([^*]+)\*", r"<em>\1</em>", out)


def markdown_html(text: str | None) -> str:
    """HTML of Markdown: headings of up to four #, lists, tables, rules, paragraphs, bold, italic, and images of http or absolute addresses."""
    out: list[str] = []
    kind = None

    def become(new: str | None):
        nonlocal kind
        if kind != new:
            out.extend(([f"</{kind}>"] if kind else []) + ([f"<{new}>"] if new else []))
            kind = new

    for line in (text or "").split("\n"):
        bare = line.strip()
        heading, item, step = re.match(r"(#{1,4})\s+(.+)$", line), re.match(r"\s*[-*+]\s+(.*)$", line), re.match(r"\s*\d+[.)]\s+(.+)$", line)
        if re.fullmatch(r"-{3,}|\*{3,}", bare):
            become(None)
            out.append("<hr>")
        elif bare.startswith("|"):
            if not re.fullmatch(r"[|\s:-]+", bare):
                first = kind != "table"
                become("table")
                cell = "th" if first else "td"
                out.append("<tr>" + "".join(f"<{cell}>{_inline(c.strip())}</{cell}>" for c in bare.strip("|").split("|")) + "</tr>")
        elif heading:
            become(None)
            out.append(f"<h{len(heading[1])}>{_inline(heading[2])}</h{len(heading[1])}>")
        elif item or step:
            become("ul" if item else "ol")
            out.append(f"<li>{_inline((item or step)[1])}</li>")
        else:
            become(None)
            out += [f"<p>{_inline(bare)}</p>"] if bare else []
    become(None)
    return "\n".join(out)


def rendered(reports: DataFrame, key: str, text: str) -> DataFrame:
    """key and the HTML of a Markdown column. State runs over the lines of a text, so it is made in Python, Arrow batch by batch."""

    def render(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([markdown_html(x) for x in batch.column("text").to_pylist()], pa.string())], names=["key", "html"])

    return reports.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(render, "key long, html string").withColumnRenamed("key", key)


@lru_cache(1 << 16)
def _place(word: str) -> tuple[int, int]:
    """Four bytes of a word's hash, and its sign."""
    digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "little"), 1 if digest[4] & 1 else -1


def hash_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of texts by hashed words: a stand-in for an embedding service."""
    out = np.zeros((len(texts), size))
    for k, text in enumerate(texts):
        if found := [_place(w) for w in text.lower().split()]:
            place, sign = np.array(found, np.int64).T
            out[k] = np.bincount(place % size, sign, size)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def ingested(docs: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray] = hash_vectors, each: int = 16) -> DataFrame:
    """key, chunk, content, tokens and embedding of guideline texts; `embed` gets `each` contents at a time."""
    cut = chunks(docs, key, text).select(F.col(key).alias("key"), "chunk", "content", "tokens")

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64 * each):
                part = batch.slice(at, 64 * each)
                texts = part.column("content").to_pylist()
                vectors = np.concatenate([np.asarray(embed(texts[a : a + each]), "f4") for a in range(0, len(texts), each)])
                offsets = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32))
                yield part.append_column("embedding", pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel())))

    return cut.mapInArrow(add, "key long, chunk int, content string, tokens long, embedding array<float>").withColumnRenamed("key", key)


def approximate_nearest(chunks: DataFrame, queries: DataFrame, key: str, vector: str, most: int = 5, bucket: float = 0.5, tables: int = 8, radius: float = 1.18) -> DataFrame:
    """query, key, similarity and rank of the `most` chunks near each query (query, vector), its own row left out, by an index of locality-sensitive hashes of unit vectors.

    The index takes every chunk; of pairs within `radius` of each other (1.18: a cosine of 0.3) those that share a bucket in one of
    `tables` are kept. Wide buckets hold much of all rows, so their pairs are neither joined nor shuffled: tasks meet the queries
    in blocks, and hand on the best of each. An approximate way beside the exact one: wider buckets or more tables find more.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(rows: DataFrame) -> DataFrame:
        return Normalizer(inputCol="_v", outputCol="_unit").transform(rows.withColumn("_v", array_to_vector("v")))

    some = usable(chunks, key, vector)
    if not (first := some.select(F.size("v").alias("n")).head(1)):
        return nearest(chunks, queries, key, vector, 1 - radius * radius / 2, most)
    width = F.size("v") == first[0]["n"]
    model = BucketedRandomProjectionLSH(inputCol="_unit", outputCol="_hash", bucketLength=bucket, numHashTables=tables, seed=1).fit(unit(some.where(width)))

    def hashes(rows: DataFrame) -> DataFrame:
        own = F.array(*(vector_to_array(F.col("_hash")[k])[0].cast("int") for k in range(tables)))
        return model.transform(unit(rows.where(width))).select(*rows.columns, own.alias("h"))

    return nearest(chunks, queries, key, vector, 1 - radius * radius / 2, most, hashes=hashes)
