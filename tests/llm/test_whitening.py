import math

import numpy as np
import pytest

from brindle.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def plain(rows):
    """From valid vectors: x, covariance, eigenvalues and directions by a dense decomposition."""
    x = np.floor(1024 * np.array(rows, "float32").astype(float)) + 100_000
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    values, axes = np.linalg.eigh(v)
    return x.astype(int), c, v, values[::-1], axes[:, ::-1]


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], "x") for i, v in vectors], SCHEMA)


def check(spark, vectors, rows, k, **options):
    """``rows``: ids of the valid ones."""
    by = dict(vectors)
    x, c, v, values, axes = plain([by[i] for i in rows])
    got = whitening.whiten(table(spark, vectors), k=k, **options).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, j) for i in rows for j in range(1, k + 1))
    found = {(r.vec_id, r.component): r for r in got}
    assert {r.n for r in got} == {len(rows)} and len({r.identity_error for r in got}) == 1
    s, n = x.sum(axis=0), len(rows)
    for j in range(k):
        w = np.array([found[i, j + 1].whitened for i in rows])
        want = c @ axes[:, j] / math.sqrt(values[j])
        assert np.allclose(w * np.sign(w @ want), want, rtol=0, atol=1e-7)
        assert found[rows[0], j + 1].explained == pytest.approx(values[j] / np.trace(v), rel=1e-9)
    w = np.array([[found[i, j + 1].whitened for j in range(k)] for i in rows])
    error = np.abs(w.T @ w / n - np.eye(k)).max()
    assert error < 1e-9 and abs(found[rows[0], 1].identity_error - error) < 1e-9
    assert [found[i, 1].deviation for i in rows] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]


def test_against_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=12) * np.linspace(1, 3, 12)) for i in range(400)]
    odd = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf"), *[0.0] * 11]), (1004, []), (1005, [1.0] * 5), (1006, [1e30] * 12)]
    check(spark, vectors + odd, [i for i, _ in vectors], 8)


def test_narrow_blocks_converge(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=40) * 0.8 ** np.arange(40)) for i in range(300)]
    check(spark, vectors, [i for i, _ in vectors], 3, width=10)
    ints = whitening.integers(table(spark, vectors))
    narrow, wide = whitening.fit(ints, 3, width=10), whitening.fit(ints, 3)
    assert narrow.passes > 3 and wide.passes == 1
    assert np.allclose(narrow.values, wide.values, rtol=1e-12)
    with pytest.raises(RuntimeError):
        whitening.fit(ints, 3, width=10, most=2)


def test_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    check(spark, [(r.vec_id, r.embedding) for r in rows], [r.vec_id for r in rows], 8)


def test_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    equal = [(i, [0.5, 0.25]) for i in range(9)]
    assert whitening.whiten(table(spark, equal)).count() == 0
    # One direction has variance; null ids and repeated rows take part.
    got = whitening.whiten(table(spark, [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation) for r in got) == [("3", 1, 3, 2048**2), ("None", 1, 3, 1024**2), ("None", 1, 3, 1024**2)]
    assert all(r.explained == pytest.approx(1) for r in got)


def test_large_counts():
    sums, x = np.array([2**61, -(2**60)]), np.array([[2**29, -(2**28)], [5, 7]])
    n = 2**32
    assert np.allclose(whitening.centred(x, n, sums), x - sums / n)
    small = whitening.centred(x, 2**20, sums // 2**12)
    assert np.allclose(small, x - (sums // 2**12) / 2**20)
    y = np.array([[1, 2], [2**31 - 1, 0]])
    rough = ((y - np.array([0.0, 0.0])) ** 2).sum(axis=1) * float(n) ** 2
    assert whitening._deviations(y, n, np.array([0, 0]), rough) == [None, None]
    assert whitening._deviations(y, 2**31, np.array([0, 0]), rough / 4) == [None, None]
    assert whitening._deviations(y[:1], 2**30, np.array([0, 0]), rough[:1] / 16) == [5 * 2**60]
