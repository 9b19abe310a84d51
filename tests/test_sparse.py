"""Sparse k-means against the dense form, of one part and of many, with and without bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import clustering, sparse

WORDS, K = 60, 4


@pytest.fixture(scope="module")
def table(spark):
    """90 documents with a few words each, as cells and as dense vectors; odd cells besides."""
    rng = np.random.default_rng(3)
    dense = np.zeros((90, WORDS))
    for i in range(90):
        words = rng.choice(WORDS // K, 6, replace=False) + WORDS // K * (i % K)
        dense[i, words] = rng.integers(1, 6, 6)
        dense[i, rng.integers(0, WORDS, 3)] += 1
    cells = [(i, w, float(dense[i, w])) for i in range(90) for w in range(WORDS) if dense[i, w]]
    # A cell in two halves, a zero, nulls, and a document of zeros.
    first = cells[0]
    cells[0] = (first[0], first[1], first[2] - 0.5)
    cells += [(first[0], first[1], 0.5), (1, 59, 0.0) if not dense[1, 59] else (1, 0, 0.0), (None, 1, 1.0), (2, None, 1.0), (2, 3, None), (500, 1, 0.0)]
    return (
        spark.createDataFrame(cells, "doc_id long, word_id long, val double").repartition(5),
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(dense)], "doc_id long, vec array<double>"),
    )


def labels(df):
    return {r.doc_id: r.cluster for r in df.collect()}


@pytest.mark.parametrize(("kind", "entries"), [("spherical", sparse.ENTRIES), ("euclidean", K * 25), ("kl", K * 25)])
def test_runs_equal_dense_runs(spark, table, kind, entries):
    cells, points = table
    m = sparse.matrix(cells, WORDS, K, kind, entries)
    assert m.parts == (1 if entries > 1000 else 3)
    found, state = sparse.kmeans(m, "separated")
    want, dense = clustering.kmeans(points, K, kind, rounds=1000)
    assert labels(found) == labels(want) and state.settled and len(state.history) > 1
    assert state.history == pytest.approx(dense.history, rel=1e-6)


def test_bounds_skip_products_and_change_nothing(spark, table):
    m = sparse.matrix(table[0], WORDS, 8)
    start = sparse.random_labels(m, 5)
    found, state = sparse.kmeans(m, start, epsilon=1e-9)
    plain, full = sparse.kmeans(m, start, epsilon=1e-9, bounds=False)
    assert labels(found) == labels(plain) and state.history == pytest.approx(full.history)
    assert set(full.computed) == {1.0} and state.computed[0] == 1 and state.computed[-1] < 0.6
    # What the bounds let through is at least what can win: recomputed by brute force from the last centers.
    word = {}
    for r in state.sums.collect():
        word.setdefault(r["cluster"], {})[r["word_id"]] = r["s"] / np.sqrt(state.squares[r["cluster"]])
    best = {}
    for r in m.rows.collect():
        sims = [round(sum(x * word.get(c, {}).get(i, 0.0) for i, x in zip(r["idx"], r["val"], strict=True)), 9) for c in range(8)]
        best[r["doc_id"]] = int(np.argmax(sims))
    assert best == labels(found)


def test_seeds(spark, table):
    cells, points = table
    m = sparse.matrix(cells, WORDS, K, "euclidean", K * 25)
    assert sparse.separated(m)[0] == clustering.farthest_documents(points, K, "euclidean")[0]


def test_an_empty_cluster_keeps_its_center(spark, table):
    m = sparse.matrix(table[0], WORDS, 2)
    far = spark.createDataFrame([(0, 0, 1.0), (0, 20, 1.0), (0, 40, 1.0), (1, 59, 1e-12)], "cluster int, word_id long, s double")
    start = sparse.given(m, far)
    all_first = sparse.update(m, m.rows.withColumn("cluster", F.lit(0)), start)
    assert all_first.sums.where("cluster = 1").count() == 1 and all_first.weights[1] == 1


def test_word_clusters(spark, table):
    m = sparse.matrix(table[0], WORDS, 2, "euclidean")
    state = sparse.given(m, spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0), (0, 2, 1.0), (1, 2, 1.0), (1, 5, 4.0)], "cluster int, word_id long, s double"))
    assert sorted(map(tuple, sparse.word_clusters(m, state).collect())) == [(1, 1), (2, 0), (5, 1)]


def test_empty(spark):
    m = sparse.matrix(spark.createDataFrame([], "doc_id long, word_id long, val double"), 10, 2)
    found, _ = sparse.kmeans(m, "random")
    assert found.count() == 0


def test_a_round_without_bounds_writes_sums_only(spark, table, monkeypatch):
    names, write = [], sparse.written
    monkeypatch.setattr(sparse, "written", lambda df, name, *by: names.append(name) or write(df, name, *by))
    sparse.kmeans(sparse.matrix(table[0], WORDS, K), "random", bounds=False, rounds=2)
    assert set(names) == {"sums", "labels"}
