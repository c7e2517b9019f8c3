"""Token files coded by a static range asymmetric numeral system (rANS).

One table of frequencies, taken over all tokens, is shared by all blocks. A block holds whole documents in
ascending order; its ids are dealt in turn to lanes, each with a state of its own, which numpy advances
together. Checkpoints (all states and the read position at a step) let parts of a block be decoded apart; a reader
takes them one by one. A checksum guards each block. The end id may be an id of texts too, so the blocks
carry the lengths of their documents; a reader finds the end id where these say, or raises.

File format: a table of block rows (bucket, block, bucket_start, n_tokens, doc_ids, lengths, payload) next to
a table of frequencies (id, frequency). Payload, little-endian: "RANS", u32 version, u32 lanes, u64 tokens,
u32 steps between checkpoints, u32 checkpoints, u64 words, u32 crc32 of all that follows; for each checkpoint
u64 word position and its states (u64); the words (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm.bpe import encoded, id_type
from caseweave.llm.common import partitions, stage

SCALE = 20
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIQIIQI")
#: Bytes of text in the range of ids that a task writes: about, and at least where there are fewer ranges than shuffle partitions.
RANGE_BYTES, LEAST_RANGE_BYTES = 64 << 20, 2 << 20
BLOCK = "bucket int, block int, bucket_start long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def quantise(counts: dict[int, int]) -> dict[int, int]:
    """Frequencies that sum to 2**SCALE, at least 1 for every id seen."""
    if not counts:
        return {}
    if len(counts) > 1 << SCALE:
        raise ValueError("more ids than the scale of frequencies")
    total, whole = sum(counts.values()), 1 << SCALE
    found = {k: max(1, n * whole // total) for k, n in sorted(counts.items())}
    spare = whole - sum(found.values())
    for k in sorted(found, key=lambda k: (-found[k], k)):
        step = max(1 - found[k], spare) if spare < 0 else spare
        found[k] += step
        spare -= step
        if not spare:
            break
    return found


class Coder:
    """Codes blocks by one table of frequencies."""

    def __init__(self, frequencies: dict[int, int], lanes: int = 2048):
        ids = np.array(sorted(frequencies), dtype=np.int64)
        size = int(ids[-1]) + 1 if len(ids) else 1
        self.lanes = lanes
        self.frequency = np.zeros(size, np.uint64)
        self.frequency[ids] = [frequencies[int(k)] for k in ids]
        self.below = np.cumsum(self.frequency, dtype=np.uint64) - self.frequency
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.frequency.astype(np.int64))

    def encode(self, ids: np.ndarray, parts: int = 4) -> bytes:
        n = len(ids)
        lanes = max(1, min(self.lanes, n // 64))
        steps = -(-n // lanes)
        every = max(1, -(-steps // parts))
        x = np.full(lanes, LOW, np.uint64)
        f_all, c_all = self.frequency[ids], self.below[ids]
        chunks, done, marks = [], 0, []
        shift, word, low = np.uint64(SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)
        for t in range(steps - 1, -1, -1):
            a = t * lanes
            f, c = f_all[a : a + lanes], c_all[a : a + lanes]
            y = x[: len(f)]
            full = np.flatnonzero(y >= f << np.uint64(63 - SCALE))
            if len(full):
                chunks.append((y[full] & low).astype("<u4"))
                done += len(full)
                y[full] >>= word
            q = y // f
            y[:] = (q << shift) + (y - q * f) + c
            if t % every == 0:
                marks.append((done, x.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        body = b"".join(struct.pack("<Q", done - at) + state.astype("<u8").tobytes() for at, state in reversed(marks)) + words.tobytes()
        return HEAD.pack(b"RANS", 1, lanes, n, every, len(marks), done, zlib.crc32(body)) + body

    @staticmethod
    def check(payload: bytes) -> int:
        """How many parts a whole block has, between its checkpoints; a damaged one raises ValueError."""
        magic, version, _, _, _, marks, _, crc = HEAD.unpack_from(payload)
        if magic != b"RANS" or version != 1 or zlib.crc32(memoryview(payload)[HEAD.size :]) != crc:
            raise ValueError("damaged block")
        return marks

    def decode(self, payload: bytes, part: int | None = None) -> np.ndarray:
        """All ids of a block, or those from one checkpoint to the next (of a block that was checked)."""
        if part is None:
            self.check(payload)
        _, _, lanes, n, every, marks, _, _ = HEAD.unpack_from(payload)
        body = memoryview(payload)[HEAD.size :]
        size = 8 * (lanes + 1)
        words = np.frombuffer(body, "<u4", offset=marks * size)
        mask, shift, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        first, last = (0, -(-n // lanes)) if part is None else (part * every, min((part + 1) * every, -(-n // lanes)))
        begin = first * lanes
        out = np.empty(min(n, last * lanes) - begin, np.uint32)
        if n:
            at = struct.unpack_from("<Q", body, (part or 0) * size)[0]
            x = np.frombuffer(body, "<u8", lanes, (part or 0) * size + 8).astype(np.uint64)
        for t in range(first, last):
            a = t * lanes
            y = x[: min(lanes, n - a)]
            slot = y & mask
            s = self.symbol[slot]
            out[a - begin : a - begin + len(y)] = s
            y[:] = self.frequency[s] * (y >> shift) + slot - self.below[s]
            few = np.flatnonzero(y < LOW)
            if len(few):
                y[few] = (y[few] << word) | words[at : at + len(few)]
                at += len(few)
        return out


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = 1 << 20) -> DataFrame:
    """Blocks of the ids (binary, narrowest type) of whole documents (doc_id, text) in ascending order, written to the shared folder.

    Every document ends with `end_id`; a null text counts as empty. Rows with the same id stay apart, ordered by a
    hash of their text and by the text; null ids come last. A document longer than a block is a block of its own.
    Tasks are ranges of ids (of ids and hashes, where one id has many rows), about one for every `RANGE_BYTES` of text.
    """
    kind = id_type(tokenizer)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("bucket_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
        tail = np.array([end_id], kind).tobytes()
        width = len(tail)
        bucket, block, start, total, held, names, lengths = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def row():
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "block": block, "bucket_start": start, "n_tokens": sum(lengths), "doc_ids": names, "lengths": lengths, "payload": b"".join(held)}], schema)

        for batch, a, ids, at in encoded(batches, tokenizer):
            raw, at = ids.astype(kind).tobytes(), at * width
            rows = batch.slice(a, len(at) - 1)
            for doc, p, q in zip(rows.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if total >= block_tokens:
                    yield row()
                    block, start = block + 1, start + total
                    held, names, lengths, total = [], [], [], 0
                held += (raw[p:q], tail)
                names.append(doc)
                lengths.append((q - p) // width + 1)
                total += lengths[-1]
        if names:
            yield row()

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = typed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // RANGE_BYTES), min(partitions(docs.sparkSession), -(-size // LEAST_RANGE_BYTES)))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return stage(typed.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").mapInArrow(blocks, BLOCK), "ids")


def frequencies(blocks: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs in all blocks; one row for each id seen comes to the driver, so at most the vocabulary."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("payload"):
                found = np.bincount(np.frombuffer(x.as_buffer(), kind))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counted = blocks.select("payload").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Tokenise docs (doc_id, text) and write them to path/blocks and path/frequencies."""
    spark = docs.sparkSession
    kind = id_type(tokenizer)
    blocks = token_blocks(docs, tokenizer, end_id)
    shared = quantise(frequencies(blocks, kind))

    def code(batches):
        import pyarrow as pa

        coder = Coder(shared)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                payload = coder.encode(np.frombuffer(row.column("payload")[0].as_buffer(), kind))
                yield row.set_column(row.schema.get_field_index("payload"), "payload", pa.array([payload], pa.binary()))

    blocks.mapInArrow(code, BLOCK).write.option("compression", "snappy").parquet(f"{path}/blocks")
    spark.createDataFrame(sorted(shared.items()), "id long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files at path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), ids if asked for (binary)."""
    shared = {r["id"]: r["frequency"] for r in spark.read.parquet(f"{path}/frequencies").collect()}  # at most the vocabulary
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    schema = "bucket int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def documents(batches):
        import pyarrow as pa

        coder = Coder(shared)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.concatenate([coder.decode(row["payload"], k) for k in range(coder.check(row["payload"]))]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                if len(ids) != ends[-1] or (ids[ends - 1] != ids[-1]).any():
                    raise ValueError("the lengths of a block do not fit its ids")
                raw, ends = memoryview(ids.tobytes()), ends.tolist()
                starts = [0, *ends[:-1]]
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array([row["bucket"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array([row["bucket_start"] + a for a in starts], pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                columns += [pa.array([p.tobytes() for p in parts], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    totals = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("_n"))  # a row for each range of ids
    bases = totals.select("bucket", (F.sum("_n").over(Window.orderBy("bucket")) - F.col("_n")).alias("_base"))
    found = blocks.mapInArrow(documents, schema).join(F.broadcast(bases), "bucket")
    return found.withColumn("start", F.col("start") + F.col("_base")).drop("bucket", "_base")
