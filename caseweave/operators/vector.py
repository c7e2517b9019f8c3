"""Retrieval by cosine similarity over array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.sources.shared import fresh_folder

#: Similarities that a task has at hand at a time: rows of an Arrow batch by all queries of a block.
CELLS = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def matrix(lists) -> np.ndarray:
    """An Arrow list column of equal lengths, without nulls, as rows of a matrix."""
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def ints(lists) -> np.ndarray:
    """An Arrow list column of equal lengths of ints as rows of a matrix."""
    return np.asarray(lists.flatten(), np.int32).reshape(len(lists), -1) if len(lists.flatten()) else np.zeros((len(lists), 0), np.int32)


def usable(rows: DataFrame, key: str, vector: str, name: str = "key") -> DataFrame:
    """name (a long) and v (doubles) of the rows whose vector is there and has no null entry."""
    typed = rows.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))
    return typed.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


class Best:
    """The best few of what came so far for each of some queries: by similarity, then by key."""

    def __init__(self, most: int, hold: int = 1 << 18) -> None:
        self.most, self.hold, self.held, self.size = most, hold, [], 0

    def add(self, query: np.ndarray, key: np.ndarray, similarity: np.ndarray) -> bool:
        """Take some in; whether all were sorted out just now."""
        self.held.append((query, key, similarity))
        self.size += len(query)
        if self.size <= self.hold:
            return False
        self.held = [self.rows()]
        self.size = len(self.held[0][0])
        self.hold = max(self.hold, 2 * self.size)
        return True

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, key, similarity = map(np.concatenate, zip(*self.held, strict=True))
        order = np.lexsort((key, -similarity, query))
        query, key, similarity = query[order], key[order], similarity[order]
        good = self._places(query) < self.most
        return query[good], key[good], similarity[good]

    @staticmethod
    def _places(query: np.ndarray) -> np.ndarray:
        first = np.r_[True, query[1:] != query[:-1]][: len(query)]
        return np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))

    def floors(self, asked: np.ndarray) -> np.ndarray:
        """What a similarity must reach to be among the best of each asked query, as of the last sorting out."""
        query, _, similarity = self.held[0]
        last = self._places(query) == self.most - 1
        full, least = query[last], similarity[last]
        at = np.minimum(np.searchsorted(full, asked), max(len(full) - 1, 0))
        return np.where(full[at] == asked, least[at], -np.inf) if len(full) else np.full(len(asked), -np.inf)


def nearest(chunks: DataFrame, queries: DataFrame, key: str, vector: str, least: float = 0.3, most: int = 5, block: int = 20_000, hashes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query, key, similarity and rank of the `most` chunks over `least` similar to each query (query, vector); a chunk with the query's own key is left out.

    Queries come as matrices of about `block` rows, one at a time, which tasks multiply with some vectors of an Arrow batch (CELLS products);
    each task hands on the best of its own chunks for each query. Beyond one block the answers of each are written to
    the shared folder. Vectors that are null or hold a null or no number match nothing, nor do those of another length than the query.
    `hashes` adds a column h (an array of ints) to rows with v: then only pairs with an equal hash in one place count.
    """
    hashed = hashes or (lambda rows: rows.withColumn("h", F.array().cast("array<int>")))
    asked = hashed(usable(queries, "query", "vector", "query"))
    blocks = max(1, -(-asked.count() // block))
    stored = hashed(usable(chunks, key, vector))
    spark = chunks.sparkSession
    marked = hashes is not None

    def one(part: DataFrame) -> DataFrame:
        rows = part.select("query", "v", "h").toArrow()  # one block
        lists, marks = rows.column("v").combine_chunks(), rows.column("h").combine_chunks()
        sizes, ids = np.asarray(lists.value_lengths()), rows.column("query").to_numpy()
        held = {int(k): (ids[sizes == k], unit(matrix(lists.filter(sizes == k))), ints(marks.filter(sizes == k))) for k in np.unique(sizes)}
        shared = spark.sparkContext.broadcast(held)

        def score(batches: Iterator):
            import pyarrow as pa

            best, floors = Best(most), {}
            for batch in batches:
                sizes = np.asarray(batch.column("v").value_lengths())
                for k in np.unique(sizes).tolist():
                    if k not in shared.value:
                        continue
                    ids, q, mine = shared.value[k]
                    own = batch.filter(pa.array(sizes == k))
                    keys, x, marks = own.column("key").to_numpy(), unit(matrix(own.column("v"))), ints(own.column("h"))
                    step = max(1, CELLS // len(ids))
                    for at in range(0, len(keys), step):
                        s = np.round(x[at : at + step] @ q.T, 6)
                        fits = (s > least) & (s >= floors[k]) if k in floors else s > least
                        fits &= keys[at : at + step, None] != ids
                        row, col = np.nonzero(fits)
                        if marked:
                            meet = (marks[at + row] == mine[col]).any(axis=1)
                            row, col = row[meet], col[meet]
                        if best.add(ids[col], keys[at + row], s[row, col]):
                            floors = {n: best.floors(found[0]) for n, found in shared.value.items()}
            query, found, similarity = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(similarity)], names=["query", "key", "similarity"])

        scored = stored.mapInArrow(score, "query long, key long, similarity double")
        by = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
        ranked = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
        return ranked.select("query", F.col("key").alias(key), "similarity", "rank")

    if blocks == 1:
        return one(asked)
    folder, parts = fresh_folder(spark, "nearest"), []
    for k in range(blocks):
        found = one(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k))
        found.write.parquet(f"{folder}/block={k}")
        parts.append(spark.read.schema(found.schema).parquet(f"{folder}/block={k}"))
    return reduce(DataFrame.unionByName, parts)


def merged(found: DataFrame, texts: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """The best hits of several searches together: chunks that begin with the same 100 characters count once."""
    joined = found.groupBy(key).agg(F.max("similarity").alias("similarity")).join(texts.select(key, text), key)
    once = Window.partitionBy(F.substring(text, 1, 100)).orderBy(F.desc("similarity"), key)
    return joined.withColumn("_k", F.row_number().over(once)).where(F.col("_k") == 1).drop("_k").orderBy(F.desc("similarity"), key).limit(most)
