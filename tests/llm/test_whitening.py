"""Embedding whitening against a step-by-step computation in numpy and exact whole numbers."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tokenmill.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, n long, component string, x string, d string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "c", "x", "d") for i, v in vectors], KIND)


def model(vectors, by_copies=False):
    """Per vector of whole numbers: n, deviation, eigenvalues, the matrix of the covariance."""
    fine = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    copies = Counter(x for _, x in fine)
    weights = copies if by_copies else {x: 1 for x in copies}
    n, d = sum(weights.values()), len(next(iter(copies)))
    total = [sum(w * x[k] for x, w in weights.items()) for k in range(d)]
    y = np.array([[n * a - b for a, b in zip(x, total)] for x in weights], object)  # n times the centred vectors, as whole numbers
    cov = (y * np.array(list(weights.values()), object)[:, None]).T @ y
    return fine, copies, weights, n, total, np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])


def check(rows, vectors, by_copies=False, components=4):
    fine, copies, weights, n, total, cov = model(vectors, by_copies)
    values = np.linalg.eigvalsh(cov)[::-1][:components]
    assert Counter((r["vec_id"], r["component"]) for r in rows) == Counter((i, k + 1) for i, _ in fine for k in range(len(values)))
    x_of = dict(fine)
    white = {}
    for r in rows:
        x = x_of[r["vec_id"]]
        assert r["n"] == n and r["n_copies"] == copies[x]
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, total))
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-9 and r["identity_error"] < 1e-8
        assert white.setdefault((x, r["component"]), r["whitened"]) == r["whitened"]
    distinct = list(weights)
    w = np.array([[white[x, k + 1] for k in range(len(values))] for x in distinct])
    share = np.array([weights[x] for x in distinct]) / n
    centre = np.array(total) / n
    assert np.allclose((w * share[:, None]).T @ w, np.eye(len(values)), atol=1e-8)
    # whitened * sqrt(value) is the projection on an eigenvector: regressing it on the centred vectors gives the vector back
    y = np.array(distinct) - centre
    for k, value in enumerate(values):
        axis = y.T @ (w[:, k] * share) / math.sqrt(value)
        assert np.allclose(np.linalg.norm(axis), 1, atol=1e-8) and np.allclose(cov @ axis, value * axis, atol=1e-7 * max(1, value))
        assert np.allclose(y @ axis / math.sqrt(value), w[:, k], atol=1e-7)


@pytest.mark.parametrize("by_copies", [False, True])
def test_whitening(spark, by_copies):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=7) * [9, 1, 2, 3, 4, 5, 6] + 20) for i in range(120)]
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in vectors]
    vectors += [(200 + i, vectors[0][1]) for i in range(90)] + [(300, [c + 1e-6 for c in vectors[1][1]]), (400, None), (401, [None] + vectors[0][1][1:]),
                (402, [float("nan")] + vectors[0][1][1:]), (403, [float("inf")] + vectors[0][1][1:]), (404, [])]
    keep = [v for v in vectors if v[0] != 404]
    check(whitening.whiten(frame(spark, vectors), by_copies=by_copies).collect(), keep, by_copies)


def test_given_table(spark):
    out = whitening.op12(spark, "/root/testdata/sf0.001")
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(out.collect(), vectors)


def test_edges(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).count() == 0  # one distinct vector has no spread
    line = [(None, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [2.0, 2.0]), (3, [2.0, 2.0])]
    got = whitening.whiten(frame(spark, line)).collect()
    assert Counter(r["vec_id"] for r in got) == {None: 2, 3: 2} and {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in got)
    mixed = frame(spark, [(1, [0.0]), (2, [4.0]), (3, [1.0, 2.0]), (4, [5.0, 9.0]), (5, [3.0, 1.0])])
    assert {(r["vec_id"], r["component"], r["n"]) for r in whitening.whiten(mixed).collect()} == {(1, 1, 2), (2, 1, 2), *((i, k, 3) for i in (3, 4, 5) for k in (1, 2))}


def test_numbers_beyond_doubles():
    x = np.array([[2**40 + 1, -(2**39)], [5, 7]], np.int64)
    for n, s in ((3, [2**41, 11]), (1 << 20, [0, 0])):
        want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
        assert whitening.deviations(x, n, s).to_pylist() == [v if v < 1 << 63 else None for v in want]
    small = np.array([[123456789, -987654], [5, 7]], np.int64)
    assert whitening.deviations(small, 17, [9, -4]).to_pylist() == [sum((17 * int(a) - b) ** 2 for a, b in zip(row, [9, -4])) for row in small]
    assert whitening._exact(x, np.array([2**40, 3])) == [(2**40 + 1) * 2**40 + 15, -(2**39) * 2**40 + 21]
