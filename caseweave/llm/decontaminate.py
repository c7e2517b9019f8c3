"""Benchmark decontamination: which documents hold a passage close to a benchmark item. DataFrame functions only.

A window as long as an item, in words, holds the item when the weighted similarity of their shingles (sum of
the smaller over sum of the larger counts) is 0.8 or more. Every such window holds a sampled shingle of the item,
at any place; so all windows around such a shingle are looked at that hold enough of the item's shingles to reach
the similarity. Their SimHash fingerprints are matched to those of the items whose shingles they hold through blocks
of bits, of which one must be equal within the radius, and what remains is verified exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import stage

WORD_EDGE = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters, marks and digits, in lower case; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_EDGE), lambda w: w != "")


def shingles(w: Column, size: Column | int, step: int = 1) -> Column:
    """Hashes of the runs of `size` words, at every `step`-th place."""
    places = F.sequence(F.lit(1), F.size(w) - size + 1, F.lit(step))
    return F.when(F.size(w) >= size, F.transform(places, lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<long>"))


def fingerprints(rows: DataFrame, hashes: str, *keys: str) -> DataFrame:
    """keys and `print`, the SimHash of the 64-bit hashes in column `hashes`, of all rows with these keys: a bit is 1 where it is in over half of them."""
    flat = rows.select(*keys, F.explode(hashes).alias("_h"))
    counted = flat.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.sum(F.getbit("_h", F.lit(b))).alias(f"_b{b}") for b in range(64)))
    found = F.lit(0).cast("long")
    for b in range(64):
        found = found.bitwiseOR(F.when(2 * F.col(f"_b{b}") > F.col("_n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, found.alias("print"))


def distinct_members(hashes: Column) -> Column:
    """The members of a multiset of hashes as different values: those that occur again by a hash with the number of their occurrence."""
    sorted_ = F.array_sort(hashes)
    again = F.transform(sorted_, lambda x, i: F.when(F.array_position(sorted_, x) == i + 1, x).otherwise(F.xxhash64(x, i + 1 - F.array_position(sorted_, x))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(again)


def similarity(a: Column, b: Column) -> Column:
    """Weighted similarity of two multisets of hashes, given as different members."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def safe_step(sizes: list[int], least: float) -> int:
    """The largest step at which some sampled shingle of every window similar to an item is the item's own.

    At similarity s two arrays of n shingles share at least 2 n s / (1 + s); n // step of a window's are sampled.
    """

    def holds(step: int) -> bool:
        return all(n // step > n - math.ceil(2 * n * least / (1 + least) - 1e-9) for n in sizes)

    return next((k for k in range(8, 1, -1) if holds(k)), 1)


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, radius: int = 15, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, item_id, window_start (the window's first word, from 0), n_words and similarity: the best window of each document and item, the earliest of equals.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Shingles have `size` words, or all
    of them where an item has fewer. Null and wordless texts and items match nothing; documents without an id
    are not reported. Rows with one id are one document, whose best window is that of any of its texts (so for
    items). The items' shingles are broadcast if there are at most `most_broadcast` of them; beyond that they are
    joined by a shuffle, whose hot shingles Spark's skew join splits.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    items = items.withColumn("n_words", F.size("_w")).withColumn("width", F.least(F.lit(size), F.col("n_words")))
    items = items.withColumn("_item", shingles(F.col("_w"), F.col("width"))).drop("_w").distinct()
    items = stage(items.withColumn("_print_of", F.xxhash64("_item")), "items")
    sizes = items.select(F.size("_item").alias("s"), "width").distinct().collect()  # at most as many as lengths of items
    many = items.agg(F.sum(F.size("_item"))).first()[0] or 0
    held = (lambda d: F.broadcast(d)) if many <= most_broadcast else (lambda d: d)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    texts = texts.withColumn("_text", F.xxhash64("text"))
    found = None
    for width in sorted({r["width"] for r in sizes}):
        step = safe_step([r["s"] for r in sizes if r["width"] == width], least)
        own = items.where(F.col("width") == width).select("item_id", "n_words", "width", F.explode("_item").alias("_h")).distinct()
        worded = texts.select("doc_id", "_text", words(F.col("text")).alias("_w"))  # a column of its own, so that it is made once a text
        sampled = worded.select("doc_id", "_text", F.posexplode(shingles(F.col("_w"), width, step)).alias("_k", "_h"))
        near = sampled.join(held(own), "_h").select("doc_id", "_text", "item_id", "n_words", "width", (F.col("_k") * step).alias("_hit"))
        found = near if found is None else found.unionByName(near)
    if found is None:
        return texts.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("window_start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    near = stage(found.groupBy("doc_id", "_text", "item_id", "n_words", "width").agg(F.collect_set("_hit").alias("_hits")), "hits")  # the documents are read again for these alone

    hit = near.join(texts, ["doc_id", "_text"]).dropDuplicates(["doc_id", "_text", "item_id", "n_words"]).withColumn("_w", words(F.col("text"))).drop("text")
    hit = hit.withColumn("_all", shingles(F.col("_w"), F.col("width"))).drop("_w")
    hit = stage(hit, "regions").join(held(items.select("item_id", "n_words", "_item").distinct()), ["item_id", "n_words"])
    length = F.col("n_words") - F.col("width") + 1
    own = F.transform("_all", lambda h: F.array_contains("_item", h))
    hit = stage(hit.select("doc_id", "_text", "item_id", "n_words", "_all", own.alias("_own"), F.array_sort("_hits").alias("_hits"), F.size("_item").alias("_size"), length.alias("_length")), "regions")
    # starts are rows before windows are cut, each of the first hit behind it, so no row holds more than its text
    ahead = hit.select("*", F.posexplode("_hits").alias("_k", "_hit")).withColumn("_last", F.coalesce(F.get("_hits", F.col("_k") - 1), F.lit(-1)))
    ahead = ahead.select("*", F.explode(F.sequence(F.greatest(F.col("_hit") - F.col("_length") + 1, F.col("_last") + 1), F.col("_hit"))).alias("window_start"))
    there = F.slice("_own", F.col("window_start") + 1, F.col("_length"))
    # the window's shingles that are in the item are at least the common ones
    enough = F.size(F.filter(there, lambda y: y)) * (1 + least) >= least * (F.size(there) + F.col("_size")) - 1e-9
    key = ["doc_id", "_text", "item_id", "n_words", "window_start"]
    windows = ahead.where(enough).select(*key, F.slice("_all", F.col("window_start") + 1, F.col("_length")).alias("_window"))
    windows = stage(windows.dropDuplicates(key).where(F.size("_window") > 0), "windows")
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def posted(df: DataFrame) -> DataFrame:
        parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        return df.withColumn("_p", F.explode(F.array(*parts))).select("*", "_p.block", "_p.bits").drop("_p")

    # a window meets only the items of which it holds a shingle, under blocks of their fingerprints; the shingles follow for what is left
    names = ["item_id", "n_words", "_print_of"]
    index = posted(stage(fingerprints(items, "_item", *names), "index")).withColumnRenamed("print", "_theirs")
    differ = F.col("print").bitwiseXOR(F.col("_theirs"))
    first_equal = F.lit(True)
    for k in range(blocks - 1):  # each pair once: at its first equal block
        equal = F.shiftrightunsigned(differ, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) == 0
        first_equal = first_equal & ((F.col("block") <= k) | ~equal)
    matched = posted(fingerprints(windows, "_window", *key)).join(held(index), ["item_id", "n_words", "block", "bits"]).where(first_equal & (F.bit_count(differ) <= radius)).select(*key, "_print_of")
    scored = matched.join(windows, key).join(held(items.select(*names, "_item")), names)
    scored = scored.withColumn("similarity", similarity(distinct_members(F.col("_window")), distinct_members(F.col("_item")))).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("window_start", "n_words", "similarity"), F.struct("similarity", (-F.col("window_start")).alias("_s")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("_b")).select("doc_id", "item_id", "_b.window_start", "_b.n_words", F.round("_b.similarity", 6).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no leak, with all their columns; those without an id stay."""
    bad = stage(leaks(docs, benchmark, **how).select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti")
