import math
from fractions import Fraction

import numpy as np
import pytest

from marketlens.llm import whitening as W


def usable(rows):
    return [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]


def check(rows, got, dim, components=4):
    """Against numpy's eigenvectors of the covariance of the distinct vectors, and exact fractions."""
    rows = [(i, x) for i, x in usable(rows) if len(x) == dim]
    distinct = np.array(sorted({tuple(x) for _, x in rows}), float)
    n = len(distinct)
    sums = [int(s) for s in distinct.sum(axis=0)]
    centred = distinct - distinct.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values, kind="stable")[:components]
    keep = [c for c in order if values[c] > 1e-9 * values.max()]
    expected = {}
    for i, x in rows:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c, k in enumerate(keep, 1):
            w = (np.array(x) - distinct.mean(axis=0)) @ vectors[:, k] / math.sqrt(values[k])
            expected.setdefault((i if i is not None else -1, c), []).append((deviation, abs(w), values[k] / values.sum()))
    found = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9
        found.setdefault((r.vec_id if r.vec_id is not None else -1, r.component), []).append((r.deviation, abs(r.whitened), r.explained))
    assert found.keys() == expected.keys()
    for key, some in expected.items():
        assert len(found[key]) == len(some)
        for a, b in zip(sorted(found[key]), sorted(some)):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-7) and a[2] == pytest.approx(b[2], rel=1e-9)


def test_smallest_table(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, W.query(spark, folder).collect(), 64)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, s, 5)]) for i, s in enumerate([0.3] * 40 + [400.0] * 10)]
    rows += [(60 + i, rows[0][1]) for i in range(20)]  # copies count once
    rows += [(0, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf] * 5), (204, [])]
    rows += [(300 + i, [float(i % 2), float(i // 2)]) for i in range(4)] + [(350, [7.0])]  # equal eigenvalues; a lone vector
    frame = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, n int, whitened double").repartition(5)
    got = W.whiten(frame).collect()
    check(rows, [r for r in got if r.vec_id is None or r.vec_id < 300], 5)
    square = [r for r in got if r.vec_id is not None and r.vec_id >= 300]
    assert sorted((r.vec_id, r.component) for r in square) == [(300 + i, c) for i in range(4) for c in (1, 2)]
    assert all(r.explained == 0.5 and r.n == 4 and r.identity_error < 1e-12 for r in square)
    assert W.whiten(frame.limit(0)).count() == 0


def test_flat_directions_and_large_entries(spark):
    rows = [(i, [float(2**40 * i), 0.0, float(i % 3)]) for i in range(9)]  # the second entry never varies
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-4
    assert all(r.deviation is None for r in got if r.vec_id != 4)  # beyond 64 bits
    assert {r.deviation for r in got if r.vec_id == 4} == {0}


def plain_polynomial(matrix):
    """Faddeev and LeVerrier, in fractions."""
    d = len(matrix)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d)) / k)
    return [int(x) for x in reversed(out)]


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    for x in (rng.integers(-9, 9, (12, 7)), rng.integers(-(2**30), 2**30, (9, 6)), np.diag([3, 3, 0, 5]), np.array([[4]]), np.kron(np.eye(2, dtype=int), rng.integers(-3, 3, (5, 3)))):
        x = x.astype(object)
        matrix = x.T @ x
        assert W.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix.tolist())


def test_roots_close_and_repeated():
    roots = [10**9 + 1, 10**9, 10**9, 17, 17, 3, 0]
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    found, shift = W.largest_roots(poly, sum(roots), 7)
    assert len(found) == 6 and all(abs(x / 2**shift - r) < 1e-30 * r + 1e-30 or abs(x - (r << shift)) <= 1 for x, r in zip(found, roots))


def test_products_by_limbs():
    rng = np.random.default_rng(6)
    data = rng.integers(-(2**50), 2**50, (40, 3))
    sums, squares = W.products(data)
    whole = data.astype(object)
    assert sums.tolist() == whole.sum(axis=0).tolist() and squares.tolist() == (whole.T @ whole).tolist()
