"""A stored inverted file for vectors: coarse centroids, residual codes of a byte a dimension, probing and exact re-ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.operators.vector import Best, matrix, nearest, unit, usable

#: Vectors of a list, and queries for one, that stand in one row.
PACK = 128
#: Centroids at most; rows that the centroids, and queries that the number of probes are fitted on (documented bounds).
MOST_LISTS, SAMPLE, TRIALS = 4096, 20_000, 64
MODEL = "centroids binary, lists int, scale binary, probes int, most int"


def centroids_of(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means; a centroid without rows takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        far = np.argsort(s[np.arange(len(x)), own])
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        total[empty] = x[far[: len(empty)]]
        c = unit(total)
    return c


def packed(rows: DataFrame, names: str = "key", bytes_of: str = "code") -> DataFrame:
    """list, keys, codes and n: up to PACK rows (list, key, code) of one list in one row, as they stand in each partition."""

    def pack(batches):
        import pyarrow as pa

        held: list[tuple[int, list[int], list[bytes]]] = []
        for batch in batches:
            for number, key, code in zip(batch.column("list").to_pylist(), batch.column("key").to_pylist(), batch.column("code").to_pylist(), strict=True):
                if not held or held[-1][0] != number or len(held[-1][1]) == PACK:
                    held.append((number, [], []))
                held[-1][1].append(key)
                held[-1][2].append(code)
            if len(held) > 1:
                yield out(held[:-1])
                held = held[-1:]
        if held:
            yield out(held)

    def out(done: list):
        import pyarrow as pa

        columns = [pa.array([d[0] for d in done], pa.int32()), pa.array([np.array(d[1], "<i8").tobytes() for d in done], pa.binary()), pa.array([b"".join(d[2]) for d in done], pa.binary()), pa.array([len(d[1]) for d in done], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["list", "keys", "codes", "n"])

    return rows.select("list", "key", "code").mapInArrow(pack, "list int, keys binary, codes binary, n int")


def build(chunks: DataFrame, key: str, vector: str, folder: str, lists: int | None = None, target: float = 0.97, most: int = 5) -> None:
    """Write the index of all chunks (vectors of one length) to a folder: once; nothing there is changed later.

    Centroids, as many as half the square root of the rows, and the scale of the codes are fitted on SAMPLE rows at most, picked by a hash of
    the key. Every chunk is then coded in the list of its nearest centroid; lists are folders, large ones of many files. Probes are as many as the exact hits of
    TRIALS sampled queries need for `target` of them to be in a probed list. Chunks with no vector, or one with a null or no number, are left out.
    """
    spark = chunks.sparkSession
    rows = usable(chunks, key, vector)
    total = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, total))) < SAMPLE).toArrow()  # about SAMPLE rows
    v = picked.column("v").combine_chunks()
    x = unit(matrix(v)) if len(picked) else np.zeros((0, 1))
    c = centroids_of(x, max(1, min(lists or int(total**0.5 / 2), MOST_LISTS, max(1, len(x)))))
    own = (x @ c.T).argmax(axis=1) if len(x) else np.zeros(0, int)
    scale = np.maximum(np.abs(x - c[own]).max(axis=0, initial=1e-9) * 1.25, 1e-9) / 127 if len(x) else np.ones(c.shape[1] if c.ndim > 1 else 1)

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                y = unit(matrix(batch.column("v")))
                at = (y @ c.T).argmax(axis=1)
                codes = np.clip(np.round((y - c[at]) / scale), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("key"), pa.array([r.tobytes() for r in codes], pa.binary())], names=["list", "key", "code"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.mapInArrow(coded, "list int, key long, code binary").repartitionByRange(tasks, "list", "key").sortWithinPartitions("list", "key")
    packed(listed).write.partitionBy("list").parquet(f"{folder}/lists")
    trials = spark.createDataFrame(picked.slice(0, TRIALS)).select(F.col("key").alias("query"), F.col("v").alias("vector"))
    hits = nearest(chunks, trials, key, vector, -1.0, most).select("query", F.col(key).alias("key")).join(rows, "key").toArrow()  # `most` for each trial
    probes = len(c)
    if hits.num_rows:
        asked = {int(k): q for k, q in zip(picked.column("key").to_pylist()[:TRIALS], x[:TRIALS], strict=True)}
        at = (unit(matrix(hits.column("v").combine_chunks())) @ c.T).argmax(axis=1)
        order = np.argsort(-(np.array([asked[q] for q in hits.column("query").to_pylist()]) @ c.T), axis=1)
        ranks = np.sort((order == at[:, None]).argmax(axis=1))
        probes = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1
    model = [(bytearray(c.astype("<f8").tobytes()), len(c), bytearray(scale.astype("<f8").tobytes()), probes, most)]
    spark.createDataFrame(model, MODEL).coalesce(1).write.parquet(f"{folder}/model")


def search(spark: SparkSession, folder: str, queries: DataFrame, chunks: DataFrame, key: str, vector: str, least: float = 0.3, most: int = 5, probes: int | None = None, refine: int = 8) -> DataFrame:
    """query, key, similarity and rank of the `most` chunks near each query (query, vector), its own row left out, by a stored index.

    A query is compared with the codes of the lists of its nearest centroids; the exact vectors of the `refine` times `most`
    closest are joined by their key and ranked. Queries meet the packs of a list as packs of their own, so neither is sent to all.
    """
    (model,) = spark.read.schema(MODEL).parquet(f"{folder}/model").collect()
    lists, probes, keep = model["lists"], min(probes or model["probes"], model["lists"]), most * refine
    c, scale = np.frombuffer(model["centroids"]).reshape(lists, -1), np.frombuffer(model["scale"])

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                q = unit(matrix(part.column("v")))
                near = np.argpartition(-(q @ c.T), probes - 1, axis=1)[:, :probes]
                ids = np.repeat(part.column("query").to_numpy(), probes)
                codes = [r.tobytes() for r in q.astype("<f4")]
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(ids), pa.array(codes, pa.binary()).take(pa.array(np.repeat(np.arange(len(q)), probes)))], names=["list", "key", "code"])

    def score(batches):
        import pyarrow as pa

        best = Best(keep)
        for batch in batches:
            for number, keys, codes, ids, vectors in zip(*(batch.column(n).to_pylist() for n in ("list", "keys", "codes", "ids", "vectors")), strict=True):
                keys, ids = np.frombuffer(keys, "<i8"), np.frombuffer(ids, "<i8")
                y = c[number] + np.frombuffer(codes, np.int8).reshape(len(keys), -1) * scale
                s = np.frombuffer(vectors, "<f4").reshape(len(ids), -1) @ y.T
                row, col = np.nonzero(keys != ids[:, None])
                best.add(ids[row], keys[col], s[row, col])
        query, found, similarity = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(similarity)], names=["query", "key", "near"])

    asked = usable(queries, "query", "vector", "query").where(F.size("v") == c.shape[1])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probed = asked.mapInArrow(probe, "list int, key long, code binary").repartitionByRange(tasks, "list", "key").sortWithinPartitions("list", "key")
    mine = packed(probed).select("list", F.col("keys").alias("ids"), F.col("codes").alias("vectors"))
    stored = spark.read.schema("keys binary, codes binary, n int, list int").parquet(f"{folder}/lists")
    scored = mine.hint("merge").join(stored, "list").select("list", "keys", "codes", "ids", "vectors").mapInArrow(score, "query long, key long, near double")
    first = Window.partitionBy("query").orderBy(F.desc("near"), "key")
    close = scored.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= keep).select("query", "key")

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                s = (unit(matrix(batch.column("q"))) * unit(matrix(batch.column("v")))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("key"), pa.array(np.round(s, 6))], names=["query", "key", "similarity"])

    held = usable(chunks, key, vector).where(F.size("v") == c.shape[1])
    both = close.join(held, "key").join(asked.withColumnRenamed("v", "q"), "query").select("query", "key", "q", "v")
    found = both.mapInArrow(exact, "query long, key long, similarity double").where(F.col("similarity") > least)
    by = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return ranked.select("query", F.col("key").alias(key), "similarity", "rank")
