"""Near-duplicates by SimHash: fingerprints, a byte-position inverted index with count filtering, components."""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import hot_rows, join_hot, remove, shared_dir, slices, stage, stage_at, utf8, word_spans

#: Bits of each byte value, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each of some UTF-8 texts laid end to end."""
    import xxhash

    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    starts, ends, first = word_spans(lower, offsets)
    docs, n = len(offsets) - 1, len(starts)
    out = np.zeros(docs, np.uint64)
    if not n:
        return out
    size = ends - starts
    total = int(size.sum())
    flat = np.full(total + n, 32, np.uint8)  # the words, one space after each
    inside = np.arange(total) + np.repeat(np.arange(n), size)
    flat[inside] = lower[np.arange(total) + np.repeat(starts - (np.cumsum(size) - size), size)]
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    words = np.diff(first)
    counts = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(docs), counts)
    head = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][owner]
    tail = np.minimum(head + shingle, first[1:][owner]) - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], 42) for a, b in zip(begin[head].tolist(), end[tail].tolist(), strict=True)], dtype=np.uint64)
    bytes_of = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        seen = np.bincount(owner * 256 + bytes_of[:, k], minlength=docs * 256).reshape(docs, 256) @ BITS
        over = (2 * seen > counts[:, None]).astype(np.uint64)
        out |= (over << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fingerprint (long) of every row of docs (doc_id, text): A-Z in lower case, shingles of `shingle` words with repeats, XXH64 (seed 42).

    A text of fewer words is one shingle; null texts and those without a word have the fingerprint zero.
    """

    def shingled(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [text_fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle) for a, b in slices(offsets, 1 << 21)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(shingled, "doc_id long, fp long")


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight byte positions such that any four positions contain one: within a third (3 + 3 + 2), or two of a third and one of the next."""
    thirds = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [t for t in thirds if len(t) == 3]
    for k, own in enumerate(thirds):
        found += [(a, b, c) for a, b in combinations(own, 2) for c in thirds[(k + 1) % 3]]
    return found


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` (3 or 4) byte positions such that any four positions contain one."""
    return position_triples() if width == 3 else list(combinations(range(8), 4))


def links(nodes: DataFrame, radius: int = 4, most: int = 4096, width: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, that connect the same fingerprints as all pairs at `radius` (4 or fewer) differing bits do.

    nodes: distinct fingerprints (fp). Two that differ in 4 bits share at least 4 of their 8 bytes at the same
    positions, so they meet under one of 20 triples of positional bytes, or of 70 sets of four (`width`; four from
    eight million fingerprints on, so that keys stay few-membered): these sets stand for the count, as lists of single bytes
    would pair a 32nd of all fingerprints with each. For pairs that meet, the shared positional bytes are counted, pairs kept from 8 - radius on, and verified by
    their differing bits, which imply the count. Fingerprints under a
    key with more than `most` go another exact way, linear in their number: two of them are linked through the
    values within 2 bits of both.
    """
    if radius not in (0, 2, 4):
        raise ValueError("the radius is 0, 2 or 4")
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    width = width or (3 if nodes.count() < 1 << 23 else 4)
    keys = F.array(*(sum((F.shiftleft(byte[p], 8 * j) for j, p in enumerate(places)), F.lit(k << 8 * width)) for k, places in enumerate(position_sets(width))))
    posted = nodes.select("fp", F.explode(keys).alias("key"))
    counted = stage(posted.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1), "keys")
    shared_keys = stage(posted.join(counted, "key"), "postings")
    few = shared_keys.where(F.col("_n") <= most).select("key", "fp")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(8))
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").where(F.col("a") < F.col("b"))
    pairs = pairs.where(shared >= 8 - radius).where(F.bit_count(differ) <= radius).select("a", "b").distinct()

    crowded = stage(shared_keys.where(F.col("_n") > most).select("fp").distinct(), "crowded")
    near = radius // 2
    inner = [sum(1 << b for b in bits) for r in range(near + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in inner]
    around = crowded.withColumn("point", F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("fp").bitwiseXOR(m))))
    least = around.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    stars = around.join(least.select("point", "a"), "point").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) but the least of each component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[one], least[two]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (least != least[least]).any():
            least = least[least]
    rest = least != np.arange(len(nodes))
    return nodes[rest], nodes[least[rest]]


def forests(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Fewer edges (a, b), a > b, that connect what edges do: each task joins about `most` of its own at a time, without a shuffle."""

    def joined(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size >= most:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(joined, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of edges (a, b), by alternating large and small stars.

    Tasks first join what edges they have by themselves. Each round is written to the shared folder, and the one
    before is deleted; the number of rounds is logarithmic in the size of a component. Hubs are left to Spark's skew
    join. The search ends when no node is below one node and above another, or below two.
    """
    spark = edges.sparkSession
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}")
        found = stage_at(df, kept[-1])
        if len(kept) > 1:
            remove(spark, kept.pop(0))
        return found

    edges = keep(forests(edges.where(F.col("a") != F.col("b"))))
    while not (
        edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        and edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("n")).where(F.col("m") < F.col("n")).isEmpty()
    ):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(small.unionByName(low.withColumnRenamed("m", "b")).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, most: int = 4096, width: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable over links) of each row of docs (doc_id, text).

    Equal fingerprints are one node however many documents share them. Null ids are never the smallest; where
    all ids of a component are null, so is component_id. Other columns of docs are ignored.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "nodes")
    labels = components(links(nodes.select("fp"), radius, most, width)).withColumnRenamed("node", "fp")
    labelled = stage(nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("_fps"))
    named = join_hot(labelled, least, "label", F.col("_fps"), hot_rows(labelled.count())).select("fp", "n", "component_id")
    found = join_hot(prints, stage(named, "named"), "fp", F.col("n"), hot_rows(prints.count()))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
