import random
import re

import numpy as np
import xxhash

from brindle.llm import simhash


def plain(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    ids = [min((rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, ids, strict=True)), key=str)


def sample(n=60):
    rng = random.Random(5)
    texts = []
    for _ in range(n):
        w = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 2)):
            w = list(w)
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    return texts


def test_fingerprint():
    for t in [*sample(), None, "", " \t\n", "A", "Ünïcode A\x0bB\x0cc D", "a b c d e", "a b \x1c c"]:
        assert simhash.fingerprint(t) == plain(t)
    long = "word " * 400_000 + "other Words here"
    assert simhash.fingerprint(long) == simhash.fingerprint(long.upper())


def test_long_text_in_runs(monkeypatch):
    t = " ".join(sample(10))
    monkeypatch.setattr(simhash, "_PIECE", 50)
    assert simhash.fingerprint(t) == plain(t)


def test_components(spark):
    texts = [*sample(), None, "", "x y", "x y", "same words here twice", "same words here twice"]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, "no id here at all"), (None, "no id here at all"), (None, "x y")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.near_dedup(df).collect()
    want = {c for _, _, c in brute(rows)}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want - {None})
    assert [r.text for r in kept if r.doc_id is None] == ["no id here at all"]


def test_hot_bucket(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63)
    fps = {int(base)}
    for _ in range(600):
        x = int(rng.choice(list(fps)))
        for b in rng.integers(0, 20, 2):
            x ^= 1 << int(b)
        fps.add(x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.links(df, bucket=50)
    from brindle.llm.components import components

    got = {r.node: r.root for r in components(links).collect()}
    forest = simhash.Forest()
    simhash.bucket_links(np.array(sorted(fps), "uint64"), 3, forest)
    assert {x: got.get(x, x) for x in fps} == {x: forest.find(x) for x in fps}
    assert links.count() < 20 * len(fps)


def test_blocks_cover_three_bits():
    masks = simhash.block_masks()
    for a in range(0, 64, 3):
        for b in range(0, 64, 5):
            for c in range(0, 64, 7):
                x = (1 << a) | (1 << b) | (1 << c)
                assert any(not x & m for m in masks)


def test_one_row_of_each_component(spark):
    rows = [(5, "a b c d e f"), (5, "quite another text of seven words"), (6, "A b c d  e f"), (6, "something longer that is no copy of the others at all"), (6, "something longer that is no copy of the others at all"), (None, ""), (None, None)]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (5, "a b c d e f"), (5, "quite another text of seven words"), (6, rows[3][1])]


def test_star_of_many_leaves(spark):
    from brindle.llm.components import components

    n = 100_000
    star = spark.range(1, n).selectExpr("0 AS u", "id AS v").unionByName(spark.range(n + 1, n + 500).selectExpr("id AS u", "id + 1 AS v")).unionByName(spark.range(1).selectExpr("id AS u", "id AS v"))
    got = components(star).groupBy("root").count().collect()
    assert sorted((r.root, r["count"]) for r in got) == [(0, n), (n + 1, 500)]


def test_small_rounds_lie_in_few_partitions(spark):
    from pyspark.sql import functions as F

    from brindle.llm.components import components

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(spark.range(1, 300).select(F.col("id").alias("u"), F.floor(F.col("id") / 3).alias("v")))
        assert got.rdd.getNumPartitions() <= 8 + 40  # the rows of a round, and the roots drawn from them
        assert {r.root for r in got.collect()} == {0} and got.count() == 300
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
