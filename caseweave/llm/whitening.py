"""Embedding whitening: a distributed centred scatter, cyclic Jacobi rotations on the driver, a broadcast projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import partitions, stage

#: Entries become whole numbers: floor(STEP * c) + SHIFT.
STEP, SHIFT = 64, 1_000_000
#: Rows that a task works on at a time.
ROWS = 4096
#: Sweeps at most; a few suffice, as they converge quadratically.
SWEEPS = 60


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    A sweep meets every pair of rows once, in rounds of disjoint pairs that are rotated together. A pair is left
    alone once its entry is negligible beside its own two diagonal ones, so small eigenvalues are as accurate as
    large ones. Of equal eigenvalues the one that ends in an earlier row comes first.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    v, even = np.eye(d), d + d % 2
    seats = np.arange(even)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(even - 1):
            one, two = seats[: even // 2], seats[even // 2 :][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            real = (one < d) & (two < d)  # an odd matrix has a row that sits out
            p, q = np.minimum(one, two)[real], np.maximum(one, two)[real]
            off = a[p, q]
            big = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not big.any():
                continue
            turned, p, q, off = True, p[big], q[big], off[big]
            with np.errstate(over="ignore"):
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(half, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            upper, lower = a[p].copy(), a[q]
            a[p], a[q] = c[:, None] * upper - s[:, None] * lower, s[:, None] * upper + c[:, None] * lower
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def whole(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers; those beyond a long are its ends."""
    scaled = np.floor(values * STEP)
    inside = np.clip(scaled, -(2.0**62), 2.0**62).astype(np.int64)
    return inside + SHIFT


def vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x (the whole numbers of the vector, eight bytes each, little-endian) of the rows whose vector is there and has only finite entries."""

    def turned(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten()
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.cumsum(np.r_[0, ~np.isfinite(values)])
            good = np.flatnonzero(np.asarray(lists.is_valid()) & (bad[ends] == bad[ends - sizes]))
            raw = whole(np.where(np.isfinite(values), values, 0)).astype("<i8")
            x = [raw[ends[j] - sizes[j] : ends[j]].tobytes() for j in good.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(good)), pa.array(x, pa.binary())], names=["vec_id", "x"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(turned, "vec_id long, x binary")


def blocks(batches):
    """Arrow batches of x (vectors of one length) as matrices of whole numbers, ROWS rows at most, each with its batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(part.num_rows, -1)


def sums(fit: DataFrame) -> np.ndarray:
    """The sum of each dimension over fit, exact: high and low halves of the entries are summed apart."""

    def added(batches):
        import pyarrow as pa

        high = low = None
        for _, x in blocks(batches):
            h, w = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            high, low = (h, w) if high is None else (high + h, low + w)
        if high is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.arange(len(high)), high, low)], names=["d", "high", "low"])

    rows = fit.mapInArrow(added, "d long, high long, low long").groupBy("d").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # a row for each dimension
    return np.array([(r["high"] << 32) + r["low"] for r in sorted(rows, key=lambda r: r["d"])], dtype=object)


def scatter(fit: DataFrame, middle: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """The sum over fit of y yᵀ, with y = x - middle, projected by `onto` if that is given: every task adds up its own, then each row of the matrix is added up by itself."""

    def packed(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], names=["i", "s"])

    def multiplied(batches):
        total = None
        for _, x in blocks(batches):
            y = centred(x, middle)
            y = y if onto is None else y @ onto
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield packed(list(enumerate(total)))

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in zip(batch.column("i").to_pylist(), batch.column("s").to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(s)
        yield packed(list(held.items()))

    spark = fit.sparkSession
    tasks = fit.coalesce(partitions(spark)).mapInArrow(multiplied, "i long, s binary")
    rows = tasks.repartition(partitions(spark), "i").mapInArrow(added, "i long, s binary").collect()  # the rows of the matrix
    out = np.array([np.frombuffer(r["s"]) for r in sorted(rows, key=lambda r: r["i"])])
    return (out + out.T) / 2


def centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """x less the whole numbers nearest to the means (exact), then less what these leave."""
    near = np.array([round(m) for m in middle], dtype=np.int64)
    rest = np.array([float(m - int(k)) for m, k in zip(middle, near, strict=True)])
    return (x - near).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - total)², exact; null beyond a long."""
    bound = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(s)) for s in total)
    if bound < 1 << 62:
        y = x * n - total.astype(np.int64)
        if int(np.abs(y).max()) ** 2 * len(total) < 1 << 63:
            return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - total
    return [s if s < 1 << 63 else None for s in (y * y).sum(axis=1).tolist()]


def whiten(df: DataFrame, most: int = 16, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each vector of df and each of its first `most` components.

    Rows whose vector is null, empty or holds a null or an entry that is not finite have no result, nor have those of
    another length than most distinct vectors have (of equally many the shortest). Null ids and equal ids stay as they are.
    The fit is on the distinct whole-number vectors: their number, their exact sums, their centred scatter (added up
    by tasks, so the driver gets d² numbers), its eigenvectors, then the covariance of the whitened vectors. A
    component of no variance (1e-12 of the largest and less) has whitened 0; then identity_error is 1. Entries are exact
    up to 2⁵⁶, a deviation beyond a long is null.
    """
    from fractions import Fraction

    spark = df.sparkSession
    rows = vectors(df, column)
    fit = stage(rows.where(F.length("x") > 0).groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    lengths = fit.groupBy(F.length("x").alias("size")).agg(F.count("*").alias("n")).collect()  # a row for each length
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], kind)
    size, n = max(((r["size"], r["n"]) for r in lengths), key=lambda r: (r[1], -r[0]))
    fit = fit.where(F.length("x") == size).select("x")
    total = sums(fit)
    middle = np.array([Fraction(int(s), n) for s in total], dtype=object)
    values, vecs = jacobi(scatter(fit, middle) / n)
    values, trace, k = np.maximum(values, 0), max(float(values.sum()), 0.0), min(most, size // 8)
    live = values[:k] > 1e-12 * values[0]
    onto = vecs[:, :k] * np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1)), 0)
    explained = values[:k] / trace if trace > 0 else np.zeros(k)
    error = float(np.abs(scatter(fit, middle, onto) / n - np.eye(k)).max())

    def projected(batches):
        import pyarrow as pa

        for part, x in blocks(batches):
            held = part.num_rows
            columns = [
                part.column("vec_id").take(pa.array(np.repeat(np.arange(held), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), held)),
                pa.array(np.full(held * k, n)),
                pa.array(deviations(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(held), k))),
                pa.array((centred(x, middle) @ onto).ravel()),
                pa.array(np.tile(explained, held)),
                pa.array(np.full(held * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.length("x") == size).mapInArrow(projected, kind)
