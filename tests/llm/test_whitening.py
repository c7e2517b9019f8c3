"""Whitening against numpy on the given vectors and on odd ones."""

import math

import numpy as np
import pytest

from caseweave.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def expected(vectors):
    """n, deviations and eigenvalues by whole-matrix numpy."""
    x = [tuple(math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, total = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    y = np.array(fit, np.float64) - np.array([s / n for s in total])
    return n, deviation, np.array(x, np.float64), y, np.array([s / n for s in total])


def test_query_equals_numpy(spark):
    rows = queries.op13_embedding_whitening(spark, SF).collect()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, x, y, mean = expected([r.embedding for r in given])
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == 16 * len(given)
    signs = {}
    for j, r in enumerate(given):
        for c in range(16):
            g = got[r.vec_id, c + 1]
            assert g.n == n and g.deviation == deviation[j]
            assert abs(g.explained / (values[c] / values.sum()) - 1) < 1e-9 and g.identity_error < 1e-9
            want = float((x[j] - mean) @ vecs[:, c]) / math.sqrt(values[c])
            sign = signs.setdefault(c, 1 if want * g.whitened > 0 else -1)
            assert abs(g.whitened - sign * want) < 1e-6


@pytest.mark.parametrize("d", [1, 2, 7, 32, 65])
def test_jacobi_is_accurate_for_small_eigenvalues_too(d):
    rng = np.random.default_rng(d)
    scale = 10.0 ** -np.linspace(0, 6, d)
    base = rng.normal(size=(3 * d, d)) + 3 * np.eye(3 * d, d)
    a = (base.T @ base) * scale[:, None] * scale
    values, vecs = whitening.jacobi(a)
    assert (np.diff(values) <= 0).all()
    assert np.abs(vecs.T @ vecs - np.eye(d)).max() < 1e-12
    # small values are as accurate as large ones: those of the inverse are the inverses
    other, _ = whitening.jacobi(np.linalg.inv(base.T @ base) / scale[:, None] / scale)
    assert np.abs(values * other[::-1] - 1).max() < 1e-8


def test_jacobi_of_matrices_without_rank():
    values, vecs = whitening.jacobi(np.zeros((3, 3)))
    assert values.tolist() == [0, 0, 0] and (vecs == np.eye(3)).all()
    values, _ = whitening.jacobi(np.ones((4, 4)))
    assert np.allclose(values, [4, 0, 0, 0], atol=1e-12)


def test_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, n long, whitened string, x int"
    rows = [(1, [0.5, 1.0], 0, "a", 1), (1, [0.5, 1.0], 0, "a", 1), (None, [0.25, -1.0], 0, None, 1), (2, None, 0, "", 1), (3, [1.0, None], 0, "", 1), (4, [float("nan"), 1.0], 0, "", 1), (5, [float("inf"), 1.0], 0, "", 1), (6, [], 0, "", 1), (7, [1.0, 2.0, 3.0], 0, "", 1), (8, [-0.5, 0.3], 0, "", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (8, 1), (8, 2)]
    n, deviation, *_ = expected([(0.5, 1.0), (0.25, -1.0), (-0.5, np.float32(0.3))])
    assert {r.n for r in got} == {3} and {(r.vec_id, r.deviation) for r in got} == {(1, deviation[0]), (None, deviation[1]), (8, deviation[2])}
    assert all(r.identity_error < 1e-9 for r in got)


def test_no_variance_and_no_rows(spark):
    kind = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 1.0), (2, 1, 0, 0.0, 0.0, 1.0)]
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0


def test_deviations_beyond_plain_arithmetic():
    x = np.array([[1 << 40, 5], [3, 1 << 41]])
    total = np.array([(1 << 40) + 3, 5 + (1 << 41)], dtype=object)
    want = [sum((2 * a - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x.tolist()]
    assert whitening.deviations(x, 2, total) == [w if w < 1 << 63 else None for w in want]
