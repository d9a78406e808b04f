"""Whitening against a dense eigendecomposition."""

import random

import numpy as np
import pytest

from interviewflow.llm import whitening


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<float>{extra}")


def dense(kept, k):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in row] for row in kept])
    n = len(x)
    centred = x - x.sum(axis=0) / n
    v = centred.T @ centred / n
    values, parts = np.linalg.eigh(v)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    k = min(k, (values > 1e-12 * values[-1]).sum())
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return deviation, centred @ parts / np.sqrt(values), values / np.trace(v)


def spread(seed, n, d):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, d)) * np.linspace(1.5, 0.5, d)
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("n,d", [(700, 64), (300, 5), (900, 120)])
def test_whitening_equals_dense(spark, n, d):
    x = spread(n, n, d)
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(x)]
    rows = [*rows, (n, rows[0][1]), (n + 1, rows[3][1]), (5, rows[5][1])]
    bad = [(-1, None), (-2, [None] * d), (-3, [float("nan")] * d), (-4, [float("inf")] + [0.0] * (d - 1)), (-5, []), (-6, [1.0])]
    docs = vectors(spark, [(*r, "x", 1) for r in [*rows, *bad]], ", x string, n int").repartition(5)
    found = sorted(whitening.whiten(docs).collect(), key=lambda r: r.vec_id)
    order = sorted(rows, key=lambda r: r[0])
    deviation, want, explained = dense([v for _, v in order], 8)
    assert [r.vec_id for r in found] == [i for i, _ in order] and {r.n for r in found} == {len(rows)}
    assert [r.deviation for r in found] == deviation
    assert all(r.identity_error < 1e-9 for r in found)
    assert np.allclose(found[0].explained, explained, rtol=1e-10)
    got = np.array([r.whitened for r in found])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7
    long = whitening.whitening_digest(docs)
    assert long.count() == len(rows) * min(8, d)
    assert {r.component for r in long.select("component").distinct().collect()} == set(range(1, min(8, d) + 1))


def test_vectors_without_spread(spark):
    assert whitening.whitening_digest(vectors(spark, [])).collect() == []
    assert whitening.whitening_digest(vectors(spark, [(1, None), (2, [])])).collect() == []
    # Equal vectors have no component; on a line there is one.
    assert whitening.whitening_digest(vectors(spark, [(1, [1.0, 2.0])] * 4)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 4)).count() == 4
    line = whitening.whitening_digest(vectors(spark, [(None, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [4.0, 8.0])])).collect()
    assert [r.component for r in line] == [1] * 3 and sorted(r.vec_id or 0 for r in line) == [0, 2, 2]
    assert abs(sum(r.whitened for r in line)) < 1e-9 and abs(line[0].explained - 1) < 1e-12


def test_deviations_beyond_64_bits(spark):
    """As they are for many millions of vectors; what has no room in the column of the query is null there."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((40, 3)) * 2.0**38, np.zeros((400, 3))]).astype(np.float32)
    docs = vectors(spark, [(i, [float(c) for c in row]) for i, row in enumerate(x)])
    deviation, _, _ = dense(x, 3)
    found = sorted(whitening.whiten(docs).collect(), key=lambda r: r.vec_id)
    assert [r.deviation for r in found] == deviation and max(deviation) > 1 << 64
    long = whitening.whitening_digest(docs).where("component = 1")
    assert {r.vec_id: r.deviation for r in long.collect()} == {i: v if v < 1 << 63 else None for i, v in enumerate(deviation)}
    x = spark.createDataFrame([([1, 2],), ([(1 << 50) - 1, 5],), (None,)], "x array<bigint>").where("x IS NOT NULL")
    many = whitening.exact_sums(x.crossJoin(spark.range(20_000)).repartition(1), 2)
    assert many == [20_000 << 50, 7 * 20_000]


def test_filter_damps_what_it_should():
    """Steps of the polynomial, not of a plain power iteration, reach close eigenvalues."""
    rng = np.random.default_rng(1)
    d = 200
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectrum = np.linspace(100, 80, d)
    v = turn * spectrum @ turn.T
    passes = []
    values, parts, residuals = whitening.leading_components(lambda block: passes.append(1) or v @ block, d)
    assert residuals.max() < 1e-10 and np.allclose(values, spectrum[:8], rtol=1e-12)
    assert np.abs(np.abs((parts * turn[:, :8]).sum(axis=0)) - 1).max() < 1e-12 and len(passes) < 200
