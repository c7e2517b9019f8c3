"""Near-duplicates by HyperMinHash: registers of leading zeros and mantissa bits, bands of them, collision-corrected estimates, exact links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import hot_rows, join_hot, mix, slices, stage, utf8
from caseweave.llm.near_links import Index, groups, hashed_texts, shared_postings, shingle_hashes

#: 2**7 registers, each of the leading zeros of its least hash and the MANTISSA bits behind them.
REGISTER_BITS, MANTISSA = 7, 10
#: Bands of registers. At a similarity of 0.85 a pair shares none with a chance of 4e-7; at 0.5 it shares one with 0.55, at 0.3 with 0.06.
BANDS, WIDTH = 25, 5
#: Standard deviations by which an estimate may be too low.
DEVIATIONS = 6
#: Seeds the names of bands (fixed value).
BAND_STEP = 0x9E3779B97F4A7C15


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The registers of each set: 0 if empty, else leading zeros + 1 and the mantissa of the least hash in the register's range. Sets are ascending, so it is the first there."""
    sets, count = len(bounds) - 1, 1 << REGISTER_BITS
    place = np.repeat(np.arange(sets), np.diff(bounds)) * count + (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    value = (hashes[first] << np.uint64(REGISTER_BITS)) >> np.uint64(16)  # 48 bits, exact as a double
    zeros = 48 - np.frexp(value.astype(np.float64))[1]
    mantissa = ((value << zeros.astype(np.uint64)) >> np.uint64(47 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(sets * count, np.uint16)
    out[place[first]] = ((zeros.astype(np.uint64) + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    return out.reshape(sets, count)


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many registers of disjoint sets of n and m shingles are equal by chance, and not empty: summed over the cells of equal zeros and mantissa, sixteen parts for the 2**MANTISSA of a mantissa."""
    count, parts = 1 << REGISTER_BITS, 16
    # sizes are rounded to 1/32 of a power of two: the chance changes little
    near = [np.round(np.log2(np.maximum(x, 1)) * 32).astype(np.int64) for x in (n, m)]
    kinds, which = np.unique(near[0] << 32 | near[1], return_inverse=True)
    one, two = (2 ** (k[:, None] / 32) / count for k in (kinds >> 32, kinds & 0xFFFFFFFF))
    zeros, part = np.divmod(np.arange(48 * parts), parts)
    low = 2.0 ** -(zeros + 1) * (1 + part / parts)
    high = low + 2.0 ** -(zeros + 1) / parts
    inside = [np.exp(-x * low) - np.exp(-x * high) for x in (one, two)]
    return (count * parts / (1 << MANTISSA) * (inside[0] * inside[1]).sum(axis=1))[which]


def may_link(equal: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether a similarity of `least` is within DEVIATIONS of the estimate of pairs: by `equal` of `filled` registers, less what is equal by chance."""
    estimate = (equal - chance_matches(n, m) * (1 - equal / np.maximum(filled, 1))) / np.maximum(filled, 1)
    return estimate >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(filled, 1))


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of each band of each set, and whether the band has a register that is not empty."""
    parts = regs[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(BAND_STEP), parts.shape[:2]).copy()
    for k in range(WIDTH):
        keys = mix(keys + parts[..., k] + np.uint64(1))
    return keys, parts.any(axis=2)


def first_bands(equal: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """The first band with a filled register in which all registers are equal, empty ones too; BANDS if there is none."""
    shape = (-1, BANDS, WIDTH)
    same = equal[:, : BANDS * WIDTH].reshape(shape).all(axis=2) & filled[:, : BANDS * WIDTH].reshape(shape).any(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)


class Registers(Index):
    """Marks are registers, keys bands of them."""

    kind = np.uint16

    def keys(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return band_keys(marks)

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return first_bands(x == y, (x > 0) | (y > 0))

    def likely(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filled = (x > 0) | (y > 0)
        equal = ((x == y) & filled).sum(axis=1)
        return may_link(equal, filled.sum(axis=1), n, m, self.percent / 100), equal


SKETCH = "doc_id long, n_shingles long, name binary, t1 long, t2 long, marks binary"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """For each row of docs (doc_id, text): the size of its set of shingles, a 128-bit name of the set, two hashes of the text, the registers."""

    def sketched(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                hashes, bounds = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                regs, raw = registers(hashes, bounds), hashes.tobytes()
                names = [xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                part = batch.slice(a, b - a)
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(names, pa.binary()), part.column("t1"), part.column("t2"), pa.array([r.tobytes() for r in regs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    return hashed_texts(docs).mapInArrow(sketched, SKETCH)


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id = component_id) of each row of docs (doc_id, text).

    A text's set has its distinct shingles of `size` words, A-Z in lower case; with fewer words all of them are one; texts
    without a word and null texts have none, and their document is linked with nothing. Two texts are linked where the
    shingles of both are at least `percent` in a hundred of those of either, checked on the full sets. Equal sets are one node however
    many documents have them. Null ids are never the smallest; where all ids of a component are null, so is
    component_id, and such rows are not kept. Repeated rows are all kept. Other columns of docs are ignored.
    """
    prints = stage(sketches(docs, size), "sketches")
    same = prints.where(F.col("n_shingles") > 0).groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.min(F.struct("t1", "t2")).alias("t"), F.first("marks").alias("marks"))
    nodes = stage(same.select(F.monotonically_increasing_id().alias("node"), "name", "first", "copies", "n", "t.t1", "t.t2", "marks"), "nodes")
    index = Registers(size, percent)
    labelled = nodes.join(groups(docs, nodes, shared_postings(nodes, index), index), "node", "left").select("name", "first", "copies", F.coalesce("label", "node").alias("label"))
    labelled = stage(labelled, "labelled")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = stage(join_hot(labelled, least, "label", F.col("members"), hot_rows(labelled.count())).select("name", "copies", "component_id"), "named")
    found = join_hot(prints.select("doc_id", "n_shingles", "name"), named, "name", F.col("copies"), hot_rows(prints.count()))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
