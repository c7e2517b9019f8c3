"""Best-fit packing of documents into token sequences of one capacity (large-item matching).

Sizes are whole numbers up to the capacity, so the plan is made from the histogram of sizes, whose length is
bounded by the capacity; Spark then deals every piece its place by its rank among the pieces of its size.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.bpe import encoded
from caseweave.llm.common import stage, unused

#: Pieces in a group that is dealt its places by one task.
BUCKET_ROWS = 1 << 16
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every document (columns doc_id, text; others are ignored).

    A document is its text's ids and `end_id`; only longer ones are cut, each piece but the last being full.
    A null or empty text is the single `end_id`. Repeated rows give repeated pieces. Null ids are kept.
    """

    def cut(batches):
        import pyarrow as pa

        tail = np.array([end_id], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch, a, ids, at in encoded(batches, tokenizer):
            rows, raw, at = [], ids.astype("<u4").tobytes(), (at * 4).tolist()
            for k, doc in enumerate(batch.column("doc_id").slice(a, len(at) - 1).to_pylist()):
                whole = raw[at[k] : at[k + 1]] + tail
                for n, x in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[x : x + 4 * capacity]
                    rows.append((doc, n, x // 4, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE + ", ids binary" * with_ids)


class Plan:
    """Where the pieces of each size go. places[size]: rows (first rank, first bin, pieces a bin, offset), by rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.places: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self._placed: dict[int, int] = defaultdict(int)
        self._gaps: list[int] = []  # ascending
        self._runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first bin, bins)
        left = {s: n for s, n in counts.items() if n}
        large = sorted(s for s in left if 3 * s > capacity)
        while large:
            size = large[-1]
            n = left[size]
            k = bisect.bisect_right(large, min(size, capacity - size)) - 1
            mate = large[k] if k >= 0 else 0
            if mate == size:
                if n == 1:
                    mate = large[k - 1] if k else 0
                else:
                    first = self._open(n // 2, capacity - 2 * size)
                    self._put(size, n // 2 * 2, first, 2, 0)
                    left[size] -= n // 2 * 2
            if mate and mate != size:
                pairs = min(n, left[mate])
                first = self._open(pairs, capacity - size - mate)
                self._put(size, pairs, first, 1, 0)
                self._put(mate, pairs, first, 1, size)
                left[size] -= pairs
                left[mate] -= pairs
                if not left[mate]:
                    large.remove(mate)
            elif not mate:
                self._put(size, n, self._open(n, capacity - size), 1, 0)
                left[size] = 0
            if not left[size]:
                large.remove(size)
        for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
            self._fill(size, left[size])

    def _open(self, bins: int, gap: int) -> int:
        first, self.bins = self.bins, self.bins + bins
        self._keep(gap, first, bins)
        return first

    def _keep(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if not self._runs[gap]:
                bisect.insort(self._gaps, gap)
            self._runs[gap].append((first, bins))

    def _put(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        self.places[size].append((self._placed[size], first, each, offset))
        self._placed[size] += n

    def _fill(self, size: int, n: int) -> None:
        """Best fit: a piece goes where the least room is left, so a bin that got one gets the next as long as it fits."""
        while n:
            k = bisect.bisect_left(self._gaps, size)
            if k == len(self._gaps):
                each = self.capacity // size
                first, bins, gap = self.bins, -(-n // each), self.capacity
                self.bins += bins
            else:
                gap = self._gaps[k]
                first, bins = self._runs[gap].pop()
                if not self._runs[gap]:
                    self._gaps.pop(k)
                each = gap // size
            full = min(bins, n // each)
            if full:
                self._put(size, full * each, first, each, self.capacity - gap)
                self._keep(gap - each * size, first, full)
                n -= full * each
            if full < bins:
                rest = min(n, each - 1) if n < each else 0
                if rest:
                    self._put(size, rest, first + full, rest, self.capacity - gap)
                    self._keep(gap - rest * size, first + full, 1)
                    n -= rest
                    full += 1
                self._keep(gap, first + full, bins - full)


def pack(pieces: DataFrame, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length of 1 to `capacity`, any more columns; those with the name of a result give way).

    Pieces over a third of the capacity are matched in pairs, largest first with the largest that fits; the
    rest best-fit what room is left. The driver sees the histogram of lengths alone. Equal rows are different
    pieces. An empty table gives an empty table.
    """
    pieces = pieces.drop("sequence_id", "offset")
    buckets = buckets or max(1, -(-pieces.count() // BUCKET_ROWS))
    bucket = unused(pieces, "_bucket")
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*(c for c in ("doc_id", "piece", "length", "ids_crc32") if c in pieces.columns)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(bucket, "length").agg(F.count("*").alias("_n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = Plan(hist, capacity)
    places = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for s, rows in plan.places.items()}
    before = F.sum("_n").over(Window.partitionBy("length").orderBy(bucket)) - F.col("_n")
    bases = counts.select(bucket, F.col("length").alias("_length"), before.alias("_base"))

    def assign(key, left, right):
        import pyarrow as pa

        length = left.column("length").to_numpy()
        order = np.lexsort((left.column("piece").to_numpy(), left.column("doc_id").fill_null(-1).to_numpy(), length))
        length = length[order]
        base = dict(zip(right.column("_length").to_pylist(), right.column("_base").to_pylist(), strict=True))
        heads = np.flatnonzero(np.r_[True, length[1:] != length[:-1]]) if len(length) else []
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for a, b in zip(heads, [*heads[1:], len(length)], strict=True):
            size = int(length[a])
            rank = base[size] + np.arange(b - a)
            first_rank, first_bin, each, start = places[size]
            at = np.searchsorted(first_rank, rank, side="right") - 1
            within = rank - first_rank[at]
            sequence[a:b] = first_bin[at] + within // each[at]
            offset[a:b] = start[at] + within % each[at] * size
        out = left.take(pa.array(order)).drop_columns([bucket])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy(bucket).cogroup(bases.groupBy(bucket)).applyInArrow(assign, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence: sequence_id, n_tokens, ids (binary); needs pieces made with_ids. A group is one sequence, so at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all, x: F.concat(all, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise once (the pieces are written to the shared folder), then pack."""
    return pack(stage(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
