"""Removal of repeated passages: windows of words that also start earlier in the corpus.

Documents are dealt to buckets, each a range of ids. A count-min prefilter finds the windows that may repeat:
every bucket sketches its windows as sorted cells of a few hash rows, the sketches are merged by ranges of
cells, and each bucket learns which of its cells another bucket has too. The sketch can only overestimate, so
no repeated window is lost. A second pass groups only the windows whose smallest estimate is two or more, by
two independent 64-bit hashes of their words, each word's hash being mixed in, so equal ones are equal windows
but for a chance of 2**-128 a pair. As buckets follow the order of ids, the first bucket that holds a window
holds its first occurrence; a bucket sends each window once however often it occurs, so no passage is too common.

A bucket cuts its values into FAN ranges at most, whatever the size of the data. Beyond FAN ranges of SHARD_BYTES
the parts of one range are merged for FAN neighbouring buckets at a time and cut again, level by level, and the
answers go back the same way; so the number of notes is in proportion to that of the buckets at each level.

What goes through the shuffle besides the documents (once) is about two bytes a window for the sketches, one
bit a cell back, 18 bytes for each window that may repeat, and one bit back; the notes once more a level.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import mix, range_buckets, run_hashes, slices, unused, utf8, word_hashes, word_spans

#: Bytes of text for each bucket and for each range of cells: what one task holds, so their numbers follow the data alone.
BUCKET_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
#: Ranges that a bucket's values are cut into, and buckets merged, at each level: 2 to this power.
FAN_BITS = 6
NOTE = "owner long, kind int, row int, shard long, cells binary, more binary"


def _packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers as compressed differences, byte by byte of all."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n), np.uint8) if n else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(steps.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class _Windows:
    """All windows of a bucket's documents, which are put in ascending order (null ids last; then by text)."""

    def __init__(self, table, width: int):
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or ""))
        self.table = table.take(order)
        data, offsets = utf8(self.table.column("text"))
        self.raw, self.offsets, self.width = data.tobytes(), offsets, width
        counts, words = [], ([], [])
        for p, q in slices(offsets, 1 << 19):  # the hashes of words need arrays many times the size of the text
            part = data[offsets[p] : offsets[q]]
            starts, ends, first = word_spans(part, offsets[p : q + 1] - offsets[p])
            counts.append(np.diff(first))
            for found, h in zip(words, word_hashes(part, starts, ends, 2), strict=True):
                found.append(h)
        self.first = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.first[-1])
        self.begin = np.flatnonzero(left >= width)  # the first word of each window
        self.a = self.b = np.zeros(0, np.uint64)
        if len(self.begin):
            self.a, self.b = (run_hashes(np.concatenate(w), width, lane)[self.begin] for lane, w in enumerate(words))

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells of one row of the sketch, ascending; which of them each window has; how many windows each has."""
        h = self.a if row == 0 else mix(self.b + np.uint64(row))
        cells, which, n = np.unique(h >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return cells, which, n

    def repeated(self, notes: dict, depth: int, bits: int, fan: int):
        """The windows whose every estimate is two or more, as (positions, a, b) in order of hash and position; and the first of each kind."""
        may = np.ones(len(self.begin), bool)
        for row in range(depth):
            cells, which, n = self.cells(row, bits)
            flags = n > 1
            for shard, p, q in _ranges(cells, bits - fan):
                flags[p:q] |= _flags(notes[1, row, shard], q - p)
            may &= flags[which]
        at = np.flatnonzero(may)
        a, b = self.a[at], self.b[at]
        order = np.lexsort((at, b, a))
        a, b, at = a[order], b[order], at[order]
        return at, a, b, _changes(a, b)


def _changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a sorted value (a, b) is not the one before it."""
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return first


def _ranges(ascending: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of each range of 2**shift values that has any."""
    number = ascending >> np.uint64(shift)
    edges = np.flatnonzero(np.diff(number)) + 1
    return [(int(number[p]), p, q) for p, q in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True) if q > p]


def _note():
    import pyarrow as pa

    return pa.schema([("owner", pa.int64()), ("kind", pa.int32()), ("row", pa.int32()), ("shard", pa.int64()), ("cells", pa.binary()), ("more", pa.binary())])


def _cut(owner: int, kind: int, row: int, a: np.ndarray, b: np.ndarray | None, shift: int) -> list[dict]:
    """A note for each range of ascending values."""
    return [{"owner": owner, "kind": kind, "row": row, "shard": s, "cells": _packed(a[p:q]), "more": None if b is None else b[p:q].astype("<u8").tobytes()} for s, p, q in _ranges(a, shift)]


def _sketch(table, bucket: str, width: int, depth: int, bits: int, fan: int):
    import pyarrow as pa

    w = _Windows(table, width)
    owner = table.column(bucket)[0].as_py()
    rows = []
    for row in range(depth):
        rows += _cut(owner, 0, row, w.cells(row, bits)[0], None, bits - fan)
    return pa.Table.from_pylist(rows, _note())


class _Together:
    """The notes of several owners on one range, in ascending order of value and owner."""

    def __init__(self, table):
        self.notes = sorted(table.to_pylist(), key=lambda x: x["owner"])
        self.values = [_unpacked(x["cells"]) for x in self.notes]
        self.kind, self.row = (self.notes[0]["kind"], self.notes[0]["row"]) if self.notes else (0, 0)
        self.exact = self.kind == 2
        a = np.concatenate(self.values or [np.zeros(0, np.uint64)])
        b = np.concatenate([np.frombuffer(x["more"], "<u8") for x in self.notes]) if self.exact else np.zeros(len(a), np.uint64)
        self.order = np.lexsort((b, a)) if self.exact else np.argsort(a, kind="stable")
        self.a, self.b = a[self.order], b[self.order]
        self.first = _changes(self.a, self.b)


def _merged(table, fan: int, shift: int):
    """What the owners of a group hold, as notes of the group on finer ranges."""
    import pyarrow as pa

    x = _Together(table)
    rows = _cut(x.notes[0]["owner"] >> fan, x.kind, x.row, x.a[x.first], x.b[x.first] if x.exact else None, shift)
    return pa.Table.from_pylist(rows, _note())


def _settled(table, outer, shift: int):
    """For each owner: which of its values another owner has too (kind 1: cells), or an earlier one (kind 3: windows). `outer`: the same for the group, by finer ranges."""
    import pyarrow as pa

    if not table.num_rows:
        return pa.Table.from_pylist([], _note())
    x = _Together(table)
    flags = ~x.first
    if not x.exact:
        flags[:-1] |= ~x.first[1:]
    if outer is not None:
        told = {y["shard"]: y["cells"] for y in outer.to_pylist()}
        distinct = x.a[x.first]
        deeper = np.zeros(len(distinct), bool)
        for s, p, q in _ranges(distinct, shift):
            deeper[p:q] = _flags(told[s], q - p)
        flags |= deeper[np.cumsum(x.first) - 1]
    back = np.empty(len(flags), bool)
    back[x.order] = flags
    ends = np.cumsum([len(v) for v in x.values]).tolist()
    rows = [{"owner": y["owner"], "kind": x.kind + 1, "row": x.row, "shard": y["shard"], "cells": _bits(back[e - len(v) : e]), "more": None} for y, v, e in zip(x.notes, x.values, ends, strict=True)]
    return pa.Table.from_pylist(rows, _note())


def settled(notes: DataFrame, bits: int, fan: int, level: int, levels: int) -> DataFrame:
    """Answers to the notes of `level`, whose ranges are known by the first fan * level of `bits` bits."""
    if level == levels:
        return notes.groupBy("row", "shard").applyInArrow(lambda t: _settled(t, None, 0), NOTE)
    shift = bits - fan * (level + 1)
    grouped = notes.withColumn("group", F.shiftright("owner", fan))
    above = grouped.drop("group").groupBy("row", "shard", F.shiftright("owner", fan)).applyInArrow(lambda t: _merged(t, fan, shift), NOTE)
    told = settled(above, bits, fan, level + 1, levels).withColumn("up", F.shiftright("shard", fan))
    return grouped.groupBy("row", "shard", "group").cogroup(told.groupBy("row", "up", "owner")).applyInArrow(lambda t, o: _settled(t, o, shift), NOTE)


def _notes(table) -> dict:
    return {(x["kind"], x["row"], x["shard"]): x["cells"] for x in table.to_pylist()}


def _candidates(table, notes, bucket: str, width: int, depth: int, bits: int, fan: int):
    import pyarrow as pa

    rows = []
    if table.num_rows:
        w = _Windows(table, width)
        _, a, b, first = w.repeated(_notes(notes), depth, bits, fan)
        rows = _cut(table.column(bucket)[0].as_py(), 2, -1, a[first], b[first], 64 - fan)
    return pa.Table.from_pylist(rows, _note())


def _kept(table, notes, width: int, depth: int, bits: int, fan: int, with_text: bool, fields):
    import pyarrow as pa

    if not table.num_rows:
        return pa.Table.from_pylist([], pa.schema(fields))
    w = _Windows(table, width)
    notes = _notes(notes)
    at, a, _, first = w.repeated(notes, depth, bits, fan)
    owners = np.flatnonzero(first)
    later = ~first
    for s, p, q in _ranges(a[owners], 64 - fan):
        later[owners[p:q]] = _flags(notes[3, -1, s], q - p)
    total = int(w.first[-1])
    step = np.zeros(total + 1, np.int64)
    begin = w.begin[at[later]]
    np.add.at(step, begin, 1)
    np.add.at(step, begin + width, -1)
    keep = np.cumsum(step[:total]) == 0
    words, removed, digests, texts = [], [], [], []
    offsets = w.offsets.tolist()
    for k, (p, q) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        kept = w.raw[offsets[k] : offsets[k + 1]].split()
        gone = q - p - int(keep[p:q].sum())
        if gone:
            kept = compress(kept, keep[p:q].tolist())
        text = b" ".join(kept)
        words.append(q - p)
        removed.append(gone)
        digests.append(hashlib.sha256(text).hexdigest())
        texts.append(text.decode("utf-8", "replace") if with_text else None)
    results = {"n_words": (words, pa.int64()), "n_removed": (removed, pa.int64()), "kept_sha256": (digests, pa.string()), "kept_text": (texts, pa.string())}
    columns = [pa.array(*results[f.name]) if f.name in results else w.table.column(f.name) for f in fields]
    return pa.Table.from_arrays(columns, schema=pa.schema(fields))


def remove_repeats(docs: DataFrame, width: int = 20, depth: int = 2, load: int = 4, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, fan: int = FAN_BITS, with_text: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Remove each word covered by a window of `width` words that also starts earlier (smaller doc_id, or the same document and an earlier word).

    docs: doc_id, text and any more columns, of which `columns` (all unless given) are kept, but those with the name of a result give way; a word is
    a longest run without the characters 32 and 9 to 13. Windows are judged on the input. Adds n_words, n_removed, kept_sha256 (of the kept words,
    one space between) and, if asked for, kept_text. Null and short texts have no window and lose nothing. Null ids come last. Rows with the same
    id are told apart by their text (by its hash first, where those of one id fill several buckets), and equal rows by chance. `depth` rows of the
    sketch have 2 to 4 x `load` / 2 cells a window. A task holds about `bucket_bytes` of text, or the cells of `shard_bytes`.
    """
    results = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    names = [c for c in (columns or docs.columns) if c.lower() not in results]
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = min(62, max(10, int(load * (size / 6 + 1)).bit_length()))
    levels = 1
    while shard_bytes << fan * levels < size and fan * (levels + 1) <= bits:
        levels += 1
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    bucket = unused(docs, "_bucket")
    row_load = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    dealt = range_buckets(typed, "doc_id", row_load, bucket_bytes, F.xxhash64("text"), bucket)
    plain = dealt.select(*dict.fromkeys([*names, "doc_id", "text"]), bucket)
    sketches = plain.groupBy(bucket).applyInArrow(lambda t: _sketch(t, bucket, width, depth, bits, fan), NOTE)
    shared = settled(sketches, bits, fan, 1, levels)
    candidates = plain.groupBy(bucket).cogroup(shared.groupBy("owner")).applyInArrow(lambda t, n: _candidates(t, n, bucket, width, depth, bits, fan), NOTE)
    verdicts = settled(candidates, 64, fan, 1, levels)
    kept = plain.select(*names).schema
    for name in results:
        kept = kept.add(name, "long" if name.startswith("n_") else "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(kept))
    return plain.groupBy(bucket).cogroup(shared.unionByName(verdicts).groupBy("owner")).applyInArrow(lambda t, n: _kept(t, n, width, depth, bits, fan, with_text, fields), kept)
