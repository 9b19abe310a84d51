"""Worked examples with known numbers, tie rules and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import paths, vectors
from brindle.operators import bow, cluster_metrics, clustering, evaluation, joins, knn, regions, sampling, vocabulary

POSTINGS = [(1, 3), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


@pytest.fixture(scope="module")
def weighted(spark):
    return bow.weights(bow.term_counts(spark.createDataFrame(POSTINGS, "fid long, word long")))


def test_tfidf(weighted):
    rows = {(r.fid, r.word): r for r in weighted.collect()}
    assert rows[1, 3].idf == pytest.approx(1.098612, abs=1e-6) and rows[1, 4].idf == pytest.approx(0.693147, abs=1e-6)
    assert [rows[k].tfidf for k in ((1, 3), (1, 4), (2, 3), (2, 4), (3, 4))] == pytest.approx([0.732408, 0.231049, 0.549306, 0.346574, 0.693147], abs=1e-6)
    assert {r.fid: round(r.factor, 6) for r in bow.factors(weighted).collect()} == {1: 1.061239, 2: 0.649500, 3: 0.693147}


def test_scores(weighted):
    got = {(r.qfid, r.fid): r.sim for r in bow.similarities(weighted, weighted, bow.factors(weighted)).collect()}
    want = {(1, 1): 2.072174, (1, 2): 1.362137, (1, 3): 0.231049, (2, 1): 0.833656, (2, 2): 0.649500, (2, 3): 0.346574, (3, 1): 0.150910, (3, 2): 0.369864, (3, 3): 0.693147}
    assert got == pytest.approx(want, abs=1e-5)
    top = bow.top(bow.similarities(weighted, weighted, bow.factors(weighted)), 2)
    assert {(r.qfid, r.rank): r.fid for r in top.collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 2, (3, 1): 3, (3, 2): 2}


def test_augmented_query_and_votes(spark, weighted):
    counts = bow.term_counts(spark.createDataFrame(POSTINGS, "fid long, word long"))
    asked = bow.term_counts(spark.createDataFrame([(9, 3), (9, 3), (9, 4), (9, 77)][:3], "fid long, word long"))
    query = bow.augmented_weights(asked, bow.inverse_frequency(counts))
    got = {r.fid: r.sim for r in bow.similarities(query, weighted, bow.factors(weighted)).collect()}
    assert got == pytest.approx({1: 2.627945, 2: 1.795137, 3: 0.462098}, abs=1e-5)
    assert {r.fid: r.n for r in bow.votes(asked, counts).collect()} == {1: 5, 2: 3, 3: 1}


def test_ties(spark):
    votes = spark.createDataFrame([(1, f, 5) for f in (3, 1, 2)], "qfid long, fid long, n long")
    assert [r.fid for r in bow.top(votes, 2, "n").orderBy("rank").collect()] == [3, 2]
    assert [r.fid for r in bow.top(votes, 2, "n", larger_id_first=False).orderBy("rank").collect()] == [1, 2]
    centers = F.array(*[F.struct(F.lit(i).alias("id"), F.array(F.lit(x)).alias("center")) for i, x in ((2, 1.0), (1, -1.0))])
    assert spark.range(1).select(vocabulary.nearest_center(F.array(F.lit(0.0)), centers).alias("k")).first().k == 1


def test_zero_norm_images_drop_out(spark):
    w = bow.weights(bow.term_counts(spark.createDataFrame([(1, 1)], "fid long, word long")))
    assert bow.factors(w).first().factor == 0 and bow.similarities(w, w, bow.factors(w)).count() == 0


def test_tier_score(spark):
    hits = spark.createDataFrame([(1, "a", r, r in (1, 2, 4, 9, 10)) for r in range(1, 11)], "qfid long, category string, rank int, hit boolean")
    got = {r.k: (r.correct, r.wrong, round(r.score, 6)) for r in evaluation.query_scores(hits).collect()}
    assert got[10] == (5, 5, 0.590909) and got[20] == (5, 5, 0.36)
    best = evaluation.category_scores(evaluation.query_scores(hits), best=10).where("k = 10").first()
    assert (best.correct, best.wrong) == (5, 5)


def region_pair_rows():
    p = [(10.0, 10.0, 2.0, 0.1), (20.0, 12.0, 2.0, 0.2), (30.0, 30.0, 4.0, 0.3)]
    q = [(11.0, 11.0, 2.0, 0.2), (33.0, 13.0, 2.0, 0.3), (25.0, 31.0, 4.0, 0.5)]
    return [(1, 2, 0, 0, i, (i, *a, 1.0), (i, *b, 1.0)) for i, (a, b) in enumerate(zip(p, q, strict=True))]


KP = "struct<k:int,x:double,y:double,scl:double,ori:double,tfidf:double>"


@pytest.mark.parametrize("mode", ["as_written", "intended"])
def test_region_consistency(spark, mode):
    df = spark.createDataFrame(region_pair_rows(), f"qfid long, fid long, qseg int, seg int, i int, p {KP}, q {KP}")
    r = regions.consistency(df, mode=mode).first()
    assert (r.n, r.mg) == (3, -1) and r.dori == pytest.approx(0.15) and r.md == pytest.approx(-0.003978874, abs=1e-8) and r.mall == pytest.approx(0.988063, abs=1e-6)
    assert regions.consistency(df.limit(1)).count() == 0
    alone = regions.consistency(df.where("i = 0"), limit=1).first()
    assert (alone.mg, alone.md, alone.mall) == (0, 0, 1)
    scores = regions.region_scores(df, regions.consistency(df, limit=4), spark.createDataFrame([(2, 2.0)], "fid long, factor double"))
    assert [tuple(x) for x in scores.collect()] == [(1, 2, 0.0)]


def test_order_violations_like_the_loop(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(25):
        n = int(rng.integers(2, 9))
        p, q = rng.permutation(50)[:n] * 1.0, rng.permutation(50)[:n] * 1.0
        rows += [(g, 2, 0, 0, i, (i, float(p[i]), float(p[i]), 1.0, 0.0, 1.0), (i, float(q[i]), float(q[i]), 1.0, 0.0, 1.0)) for i in range(n)]
        order = np.argsort(p)  # ser of the sorted query side
        place = [(0.0, i) for i in range(n)]
        for i in range(n):
            place[order[i]] = (q[i], int(order[i]))
        labels = [s for _, s in sorted(place)]
        want[g] = -sum(b < a for a, b in zip(labels, labels[1:], strict=False))
    df = spark.createDataFrame(rows, f"qfid long, fid long, qseg int, seg int, i int, p {KP}, q {KP}")
    assert {r.qfid: r.mg for r in regions.consistency(df).collect()} == want


def test_ratio_matches_collapse_equal_distances(spark):
    left = spark.createDataFrame([(0, 1, [0.0])], "pair long, kp_id long, vec array<double>")
    right = spark.createDataFrame([(0, 5, [1.0]), (0, 6, [-1.0]), (0, 7, [4.0])], "pair long, kp_id long, vec array<double>")
    r = knn.ratio_matches(left, right, 0.8, 0.1).first()
    assert (r.right_kp, r.d1, r.ratio) == (6, 1.0, 0.25)
    zero = spark.createDataFrame([(0, 5, [0.0])], "pair long, kp_id long, vec array<double>")
    assert knn.ratio_matches(left, zero).first().ratio is None


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(x)], "kp_id long, fid long, vec array<double>")
    got = {(r.q_kp, r["rank"]): r.kp_id for r in knn.nearest(df.where("kp_id % 30 = 0"), df, 7, block=16).collect()}
    for q in (0, 30, 60):
        want = np.lexsort((np.arange(90), np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 6)))[:7]
        assert [got[q, k + 1] for k in range(7)] == want.tolist()
    found = {(r.q_kp, r.kp_id) for r in knn.nearest_lsh(df.where("kp_id % 30 = 0"), df, 7, width=4.0, tables=10, hashes=1).collect()}
    exact = {(q, k) for (q, _), k in got.items()}
    assert len(found & exact) >= 0.9 * len(exact)
    votes = {r.fid: r.n for r in knn.image_votes(knn.nearest(df.where("kp_id = 0"), df, 90).withColumn("qid", F.lit(0)), once=True).collect()}
    assert set(votes.values()) == {1}


@pytest.mark.parametrize("n", [0, 1, 40, 100, 101])
def test_exact_samples(spark, n):
    df = spark.range(100).withColumnRenamed("id", "i").repartition(7)
    some, rest = sampling.exact(df, n, "i", seed=3)
    a, b = {r.i for r in some.collect()}, {r.i for r in rest.collect()}
    assert (len(a), len(b)) == ((n, 100 - n) if n <= 100 else (0, 0)) and not a & b
    assert a == {r.i for r in sampling.exact(df.repartition(2), n, "i", seed=3)[0].collect()}


def test_stratified_and_renumbered(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 4).alias("g"))
    some = sampling.stratified(df, 10, "g", "id")
    assert {r.g: r["count"] for r in some.groupBy("g").count().collect()} == dict.fromkeys(range(4), 10)
    rows = sampling.renumbered(some, "g", "id").orderBy("g", "id").collect()
    assert [r.new_id for r in rows] == list(range(40))


def test_lookups(spark):
    listed = spark.createDataFrame([(0, "a", 5), (1, "b", 6), (2, "a", 7)], "line long, path string, fid long")
    asked = spark.createDataFrame([(0, "a"), (1, "zz")], "line long, path string")
    assert {r.line: r.fid for r in joins.ids_of_paths(asked, listed).collect()} == {0: 7, 1: 0}


def test_paths(spark):
    rows = [("/x/cat_1/y/f.v1.jpg",), ("plain.jpg",), (r"c:\pics\dogs_big\a.png",)]
    df = spark.createDataFrame(rows, "p string").select(paths.category(F.col("p")), paths.object_type(F.col("p")), paths.base_name(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [("y", "y", "f.v1"), ("", "", "plain"), ("dogs_big", "dogs", "a")]
    pair = spark.createDataFrame([(r"x\crop10\q_1.jpg", "q.jpg"), ("x/r_1.jpg", "q.jpg"), ("x/crop90/crop5/z.jpg", "q.jpg")], "found string, asked string")
    assert [r[0] for r in pair.select(paths.crop_class(F.col("found"), F.col("asked"))).collect()] == [3, -1, -2]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [0.5, 0.5], [1.0, 0.0])], "a array<double>, z array<double>, p array<double>, q array<double>")
    col = F.col
    row = df.select(
        vectors.normalise_l2(col("a")), vectors.normalise_l2(col("z")), vectors.kl(col("p"), col("q")), vectors.kl(col("q"), col("p")), vectors.squared_distance(col("a"), F.array(F.lit(1.0))),
        vectors.truncated(F.array(F.lit(-1.7), F.lit(1.7))), vectors.js(col("p"), col("q"), F.lit(1.0), F.lit(1.0)),
    ).first()
    assert row[0] == [0.6, 0.8] and row[1] == [0.0, 0.0] and row[2] == 1e20 and row[3] == pytest.approx(math.log(2)) and row[4] == math.inf and row[5] == [-1, 1]
    assert row[6] == pytest.approx(0.5 * (0.5 * math.log(0.5 / 0.75) + 0.5 * math.log(0.5 / 0.25)) + 0.5 * math.log(1 / 0.75))


def test_cluster_metrics_of_a_perfect_clustering(spark):
    table = cluster_metrics.confusion(spark.createDataFrame([(i % 3, i % 3 + 10) for i in range(30)], "cluster int, label int"))
    assert cluster_metrics.f_measure(table).first()[0] == pytest.approx(1) and cluster_metrics.normalised_mutual_information(table).first().nmi == pytest.approx(1)
    assert all(r.purity == 1 and r.entropy == 0 for r in cluster_metrics.purity_entropy(table, 3).collect())


def blobs(spark, kind="spherical"):
    rng = np.random.default_rng(0)
    centers = np.abs(rng.normal(size=(3, 6))) * 4
    x = np.abs(np.repeat(centers, 20, axis=0) + rng.normal(0, 0.2, (60, 6)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 6)] * (kind != "euclidean")
    return spark.createDataFrame(rows, "doc_id long, vec array<double>")


@pytest.mark.parametrize("kind", clustering.KINDS)
def test_kmeans_finds_blobs(spark, kind):
    found, state = clustering.kmeans(blobs(spark, kind), 3, kind, alpha=0.5 if kind == "kl" else 0.0, rounds=12)
    rows = {r.doc_id: r.cluster for r in found.collect()}
    assert all(len({rows[i] for i in range(20 * k, 20 * k + 20)}) == 1 for k in range(3)) and len({rows[i] for i in range(60)}) == 3
    assert rows.get(99, -1) == -1
    steady = state.history if kind != "kl" else state.history[-2:]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(steady, steady[1:], strict=False))
    again = clustering.update(found, 3, kind, state.centers)
    assert again.objective == pytest.approx(state.objective, rel=1e-6)


@pytest.mark.parametrize("kind", clustering.KINDS)
def test_moves_gain_what_they_say(spark, kind):
    points = blobs(spark, kind).withColumn("cluster", F.when(F.col("doc_id") == 99, -1).otherwise(F.col("doc_id") % 3).cast("int"))
    state = clustering.update(points, 3, kind)
    best = clustering.move_table(points, state, clustering._counts(points, 3)).orderBy(F.col("gain").desc()).first()
    moved = clustering.update(clustering.assign_fixed(points, {best.doc_id: best.target}), 3, kind, state.centers)
    assert moved.objective - state.objective == pytest.approx(best.gain, rel=1e-3, abs=2e-3)
    new, gain = clustering.first_variation(points, state, steps=2)
    after = clustering.update(new, 3, kind, state.centers)
    assert gain > 0 and after.objective == pytest.approx(state.objective + gain, rel=1e-3, abs=5e-3)
    split, _, more = clustering.split_worst(points, state)
    assert more > 0 and split.select("cluster").distinct().count() == 4 + (kind != "euclidean")
    assert clustering.split_worst(points, state, omega=1e9)[2] == 0


def test_sequential_bottleneck_and_signs(spark):
    rows = {r.doc_id: r.cluster for r in clustering.information_bottleneck(blobs(spark, "kl"), 3, seed=4).collect()}
    assert len({rows[i] for i in range(60)}) == 3 and rows[99] == -1
    both = spark.createDataFrame([(i, [s * 1.0, s * 2.0]) for i, s in enumerate((1, -1, 2, -3))], "doc_id long, vec array<double>")
    found, state = clustering.kmeans(both, 1, "diametric")
    sides = {r.doc_id: r.cluster for r in clustering.signed_split(found, state).collect()}
    assert sides[0] == sides[2] != sides[1] == sides[3]


def test_hierarchy_is_a_partition(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))], "kp_id long, vec array<double>")
    assigned = vocabulary.hierarchy(df, k=3, levels=2, least=15, rounds=4, epsilon=0.01)
    tree = vocabulary.tree(assigned, df)
    nodes = {r.node_id: r for r in tree.collect()}
    assert assigned.where("level = 2").count() == 120 == sum(r.n for r in nodes.values() if r.level == 2)
    for r in nodes.values():
        if not r.is_leaf:
            children = [nodes[i] for i in range(r.child_lo, r.child_hi + 1)]
            assert sum(c.n for c in children) == r.n and all(c.parent_id == r.node_id for c in children)
            assert np.allclose(np.average([c.center for c in children], axis=0, weights=[c.n for c in children]), r.center)
    words = {r.word for r in vocabulary.descend(df, tree, 2).collect()}
    assert all(nodes[w].is_leaf for w in words)


@pytest.mark.parametrize("name", ["c4_spherical_kmeans", "c8_diametric_kmeans"])
def test_registered_runs_end_by_their_stop_rule(spark, monkeypatch, name):
    from brindle.plans import registry

    registry.load()
    states, run = [], clustering.kmeans
    monkeypatch.setattr(clustering, "kmeans", lambda *a, **b: states.append(run(*a, **b)) or states[-1])
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    history = states[-1][1].history
    assert history[-1] - history[-2] <= 1e-3 * abs(history[-1])


def test_registered_hierarchy_has_the_references_branches(spark):
    from brindle.plans import registry

    registry.load()
    rows = registry.QUERIES["c2_hierarchical_vocabulary"](spark, "/root/testdata/sf0.001")
    assert rows.where("level = 1").select("cid").distinct().count() > 4


def test_large_query_sets_are_joined_in_parts(spark):
    """A query set over the limit, and words of more images than a part, give the same rows as a broadcast."""
    rows = [(f, w) for f in range(40) for w in {0, f % 3, f % 7, f % 11 + 20} for _ in range(w % 2 + 1)]
    counts = bow.term_counts(spark.createDataFrame(rows, "fid long, word long"))
    weighted = bow.weights(counts)
    asked, norms = weighted.where("fid < 9"), bow.factors(weighted)
    few, many = bow.similarities(asked, weighted, norms), bow.similarities(asked, weighted, norms, rows=3, part=4)
    assert {(r.qfid, r.fid): r.sim for r in few.collect()} == pytest.approx({(r.qfid, r.fid): r.sim for r in many.collect()}, abs=2e-6)
    votes = [sorted(map(tuple, bow.votes(counts.where("fid < 9"), counts, **o).collect())) for o in ({}, {"rows": 3, "part": 4})]
    assert votes[0] == votes[1] and len(votes[0]) == 9 * 40


def test_perturbed_centers_lie_about_the_mean(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1, 0.2, (60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    found = clustering.start(df, 5, "spherical", "perturbed", seed=3)
    mean = (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(axis=0)
    mean /= np.linalg.norm(mean)
    assert found.shape == (5, 8) and len(np.unique(found.round(6), axis=0)) == 5
    assert (found @ mean > 0.9).all() and np.allclose(np.linalg.norm(found, axis=1), 1)
    assert np.allclose(found, clustering.start(df, 5, "spherical", "perturbed", seed=3))


def test_lsh_filters_where_vectors_cluster(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(40, 24))
    x = np.repeat(centers, 25, axis=0) + rng.normal(0, 0.08, (1000, 24))
    df = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(x)], "kp_id long, fid long, vec array<double>")
    q, options = df.where("kp_id % 20 = 0"), {"width": 1.0, "tables": 20, "hashes": 6}
    pairs = knn.lsh_pairs(q, df, **options).select("q_kp", "kp_id").collect()
    assert len(pairs) == len(set(pairs)) < 0.2 * 50 * 1000
    true = {(r.q_kp, r.kp_id) for r in knn.nearest(q, df, 20).collect()}
    found = {(r.q_kp, r.kp_id) for r in knn.nearest_lsh(q, df, 20, **options).collect()}
    assert len(true & found) >= 0.9 * len(true)
    seen = {r.q_kp: r.n for r in knn.seen_within(q, df, 1.0, block=64).collect()}
    assert seen == {i: int((np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6) <= 1.0).sum()) for i in range(0, 1000, 20)}
