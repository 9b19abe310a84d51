import math
import random
import zlib

import numpy as np
import pytest

from brindle.llm import linear, quality, toxicity

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("aeioulmnrst") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def make(n, start=0):
    rows = []
    for i in range(start, start + n):
        words = [RNG.choice(WORDS) for _ in range(RNG.randint(5, 80))]
        kind = i % 6
        if kind == 0:
            words = [w + RNG.choice(["%%%", "$$$"]) for w in words]
        elif kind == 1:
            words.insert(RNG.randrange(len(words)), RNG.choice(["Vilefoo", "vilebar,", "vilebaz"]))
        rows.append((i, " ".join(words), kind != 0, kind == 1))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = make(1800)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id long, text string, selected string").repartition(3)
    labels = spark.createDataFrame([(i, int(q), int(x)) for i, _, q, x in rows[:1200]] + [(None, 1, 1), (5, None, 0), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_toxicity_on_held_out_rows(data):
    rows, docs, labels = data
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    right = sum(got[i].is_toxic == x for i, _, _, x in rows[1200:])
    assert len(got) == 1800 and right >= 0.97 * 600
    assert not any(got[i].is_toxic for i, _, q, x in rows if q and not x)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].is_toxic}


def test_quality_on_held_out_rows(data):
    rows, docs, labels = data
    got = {r.doc_id: r for r in quality.quality(docs, labels, keep=["doc_id"]).collect()}
    assert sum(got[i].selected == q for i, _, q, _ in rows[1200:]) >= 0.97 * 600
    means = [np.mean([got[i].expected_grade for i, _, q, x in rows[1200:] if (0 if not q else 1 if x else 2) == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    kept = quality.select(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.selected for r in got.values())


def test_odd_rows(spark, data):
    _, docs, labels = data
    odd = spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-3, " \n"), (-4, "x" * 10_000), (-5, "%%% $$$")] + [(-6, "twice")] * 2, "doc_id long, text string")
    both = docs.select("doc_id", "text").limit(300).unionByName(odd)
    for f in (toxicity.toxicity, quality.quality):
        assert f(both, labels).count() == 308
        assert f(docs.limit(0), labels).count() == 0
    none = labels.limit(0)
    assert toxicity.clean(odd, none).count() == 8 and quality.select(odd, none).count() == 8
    one = labels.where("quality = 1 AND toxic = 0")
    assert toxicity.clean(docs, one).count() == 1800 and quality.select(docs, one).count() == 1800


def test_chain_uses_out_of_fold_predictions(data):
    _, docs, labels = data
    sample = linear.labelled(docs, labels, toxicity.LABELS)
    assert len(sample) == 1200 and len(set(sample.fold)) == 5
    models = toxicity.fit_chain(sample, toxicity.categories(sample.labels))
    assert [len(m.extra) for m in models] == [0, 1, 2]
    again = toxicity.fit_chain(linear.labelled(docs.repartition(7), labels, toxicity.LABELS), toxicity.categories(sample.labels))
    assert again[1].thresholds == pytest.approx(models[1].thresholds)
    assert len(linear.labelled(docs, labels, toxicity.LABELS, rows=100)) <= 100


def test_ordinal_gradient():
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.integers(0, 2, (n, 3))
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=n)
    y = np.digitize(latent, [-0.5, 1.5])
    row, col = np.nonzero(x)
    sample = linear.Sample(y[:, None], (row, col), (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), np.zeros(n, int))
    model = linear.fit(sample, y, 3, steps=800, decay=0.0)
    assert model.thresholds == pytest.approx([-0.5, 1.5], abs=0.25)
    assert [model.weights.get(i, 0) for i in range(3)] == pytest.approx([2, -1, 0], abs=0.25)
    assert model.thresholds[0] < model.thresholds[1]


def test_shapes():
    assert [linear.shape(w) for w in ("word", "Word.", "WORD!!", "|", "a%%%", "É", "")] == ["l", "l.", "U!!", "|", "l%%%", "l", ""]
    assert linear.word_features("...") == () and set(linear.word_features("(Abcdefg)")) == set(linear.word_features("abcdefg"))


# A plain version: no tables of known words, no sparse arrays, one text at a time.


def plain_features(text):
    words = (text or "").split()
    bucket = lambda kind, value: zlib.crc32(f"{kind}:{value}".encode()) % (1 << 20)
    present, shapes = set(), {}
    for word in words:
        core = word.lower()
        while core and not core[0].isalnum():
            core = core[1:]
        while core and not core[-1].isalnum():
            core = core[:-1]
        if core:
            present |= {bucket("w", core)} | {bucket(f"p{k}", core[:k]) for k in (4, 5) if len(core) >= k}
        stem = word
        while stem and not stem[-1].isalnum():
            stem = stem[:-1]
        shape = ("U" if len(stem) > 1 and stem.isupper() else "l" if stem else "") + word[len(stem) :][:3]
        shapes[bucket("s", shape)] = shapes.get(bucket("s", shape), 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if repeats:
        shapes[zlib.crc32(b"repeats") % (1 << 20)] = repeats
    return present, {k: math.sqrt(n / len(words)) for k, n in shapes.items()}


def plain_score(model, text, before=()):
    present, shares = plain_features(text)
    total = math.fsum(model.weights.get(i, 0) for i in present) + math.fsum(model.weights.get(i, 0) * v for i, v in shares.items())
    return total + math.fsum(a * b for a, b in zip(model.extra, before, strict=True))


def plain_sigmoid(x):
    return 1 / (1 + math.exp(-x))


def documents_and_labels(spark):
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_against_a_plain_version(spark):
    docs, labels = documents_and_labels(spark)
    model = quality.fit_grades(docs, labels)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) >= 200
    for r in rows:
        tails = [plain_sigmoid(plain_score(model, r.text) - t) for t in model.thresholds]
        assert got[r.doc_id].p_tail == pytest.approx(tails[0], abs=1e-9) and got[r.doc_id].expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert got[r.doc_id].selected == (got[r.doc_id].p_tail >= quality.THRESHOLD)


def test_chain_against_a_plain_version(spark):
    docs, labels = documents_and_labels(spark)
    sample = linear.labelled(docs, labels, toxicity.LABELS)
    models = toxicity.fit_chain(sample, toxicity.categories(sample.labels))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for r in docs.collect():
        before, want = [], []
        for m in models:
            odds = plain_score(m, r.text, before) - m.thresholds[0]
            want.append(plain_sigmoid(odds))
            before.append(max(-8, min(8, odds)))
        assert [got[r.doc_id][f"p_{c}"] for c in toxicity.CHAIN] == pytest.approx(want, abs=1e-9)
        assert got[r.doc_id].is_toxic == (max(want[1:]) >= toxicity.THRESHOLD)


def test_fit_is_the_plain_minimum():
    """The fitted model's loss is that of a plain gradient descent on the same features, run long."""
    rng = np.random.default_rng(8)
    n, m = 200, 12
    x = rng.random((n, m)) < 0.3
    grade = np.clip((x @ rng.normal(0, 2, m) + rng.logistic(0, 1, n)).round().astype(int) + 1, 0, 2)
    row, column = np.nonzero(x)
    sample = linear.Sample(grade[:, None], (row, column), (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), np.zeros(n, int))
    model = linear.fit(sample, grade, 3, steps=2000, decay=1e-2, most=None)

    def loss(w, t):
        s = x @ w
        up = np.column_stack([1 / (1 + np.exp(s - t[0])), 1 / (1 + np.exp(s - t[1])), np.ones(n)])
        p = np.diff(np.column_stack([np.zeros(n), up]), axis=1)[np.arange(n), grade]
        return -np.log(p).mean() + 0.5 * 1e-2 * (w @ w)

    w, t = np.zeros(m), np.array([-1.0, 1.0])
    for _ in range(3000):
        g = np.array([(loss(w + d, t) - loss(w - d, t)) / 2e-5 for d in 1e-5 * np.eye(m)])
        h = np.array([(loss(w, t + d) - loss(w, t - d)) / 2e-5 for d in 1e-5 * np.eye(2)])
        w, t = w - 0.5 * g, t - 0.5 * h
    fitted = np.array([model.weights.get(i, 0) for i in range(m)])
    assert loss(fitted, np.array(model.thresholds)) == pytest.approx(loss(w, t), abs=1e-3)


def test_every_link_has_positives_in_the_pipeline(spark, monkeypatch):
    import corpus_pipeline as cp

    sf, seen, true = "/root/testdata/sf0.01", [], toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda sample, targets, **o: seen.append([int(y.sum()) for y in targets]) or true(sample, targets, **o))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.select_quality(spark, docs, sf)
    cp.drop_toxic(spark, kept, sf)
    assert len(seen) == 1 and min(seen[0]) > 30 and len(set(seen[0])) == 3


def test_the_sample_is_bounded(spark, data):
    """Rows that repeat a labelled id bring one row; a row brings so many features at most."""
    from pyspark.sql import functions as F

    _, docs, labels = data
    repeated = docs.withColumn("text", F.col("text")).crossJoin(spark.range(30)).drop("id")
    want, got = (linear.labelled(d, labels, ["quality", "toxic"], rows=50) for d in (docs, repeated))
    assert len(got) == len(want) == 50
    for name in ("labels", "fold", "word_row", "word", "share_row", "share", "value"):
        assert np.array_equal(getattr(got, name), getattr(want, name))
    assert quality.fit_grades(repeated, labels).weights == quality.fit_grades(docs, labels).weights
    # Of different texts of one id that of the least hash is taken, whatever the order.
    two = docs.select("doc_id", "text").unionByName(docs.select("doc_id", F.lit("another text").alias("text")))
    a, b = (linear.labelled(d, labels, ["quality"], rows=40) for d in (two, two.repartition(7, "text")))
    assert len(a) == 40 and np.array_equal(a.word, b.word) and np.array_equal(a.word_row, b.word_row)
    long = docs.where("doc_id = 7").select("doc_id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("word"), i.cast("string")))).alias("text"))
    assert len(linear.labelled(long, labels, ["quality"]).word) == linear.ENTRIES
