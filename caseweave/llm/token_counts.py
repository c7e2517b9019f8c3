"""Tokens of each document in flat, unindexed token files, by a scan for the end-of-document id.

A flat file is one stream of ids cut into blocks without regard to documents. Each block is searched by
numpy on its own; a prefix scan over the blocks of a file then stitches the documents that cross blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.bpe import encoded, id_type
from caseweave.llm.common import stage


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = 1 << 18) -> DataFrame:
    """Write docs (doc_id, text) as flat token files, one for each input partition.

    Gives (file, part, ids, doc_ids): rows with ids are blocks numbered by `part`; rows with doc_ids list the
    documents in the order of the file, from ordinal `part` on. Null texts are empty, so only their end id is
    written. The strings of special tokens in a text are ordinary text, so `end_id` ends documents only.
    """
    kind = id_type(tokenizer)

    def flat(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        schema = pa.schema([("file", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
        size = block_tokens * np.dtype(kind).itemsize
        rest, block, ordinal = b"", 0, 0
        for batch, a, ids, at in encoded(batches, tokenizer, True):
            n = len(at) - 1
            stream = np.insert(ids, at[1:], end_id).astype(kind).tobytes()
            rest += stream
            full = len(rest) // size
            rows = [{"file": file, "part": block + k, "ids": rest[k * size : (k + 1) * size], "doc_ids": None} for k in range(full)]
            rest, block = rest[full * size :], block + full
            rows.append({"file": file, "part": ordinal, "ids": None, "doc_ids": batch.column("doc_id").slice(a, n).to_pylist()})
            ordinal += n
            yield pa.RecordBatch.from_pylist(rows, schema)
        if rest:
            yield pa.RecordBatch.from_pylist([{"file": file, "part": block, "ids": rest, "doc_ids": None}], schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(plain.mapInArrow(flat, "file int, part long, ids binary, doc_ids array<long>"), "flat")


def scan(files: DataFrame, end_id: int, kind: str) -> DataFrame:
    """Documents of flat files (file, part, ids): file, ordinal (from 0), n_tokens (without the end id). Ids after the last end id are no document."""

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), kind)
                at = np.flatnonzero(ids == end_id)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, np.diff(at) - 1))
            n, ends, first, last, inner = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [pa.array(n, pa.int64()), pa.array(ends, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("part"), *columns], names=["file", "part", "n", "ends", "first", "last", "inner"])

    found = files.where(F.col("ids").isNotNull()).select("file", "part", "ids").mapInArrow(search, "file int, part long, n long, ends long, first long, last long, inner array<long>")
    order = Window.partitionBy("file").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumn("_ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    found = found.withColumn("_open", F.coalesce(F.max(F.col("_at") + F.col("last") + 1).over(before), F.lit(0)))
    head = F.array(F.col("_at") - F.col("_open") + F.col("first"))
    lengths = found.where(F.col("ends") > 0).select("file", "_ordinal", F.posexplode(F.concat(head, "inner")).alias("_k", "n_tokens"))
    return lengths.select("file", (F.col("_ordinal") + F.col("_k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and n_tokens of every row of docs, from the flat files written of them."""
    files = write_flat(docs, tokenizer, end_id)
    names = files.where(F.col("doc_ids").isNotNull()).select("file", "part", F.posexplode("doc_ids").alias("_k", "doc_id"))
    names = names.select("file", (F.col("part") + F.col("_k")).alias("ordinal"), "doc_id")
    return names.join(scan(files, end_id, id_type(tokenizer)), ["file", "ordinal"]).select("doc_id", "n_tokens")
