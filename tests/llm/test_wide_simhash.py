import random

import numpy as np

import corpus_pipeline as cp
from brindle.llm import wide_simhash


def plain(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    """The least id of each row's group."""
    sets, comp = [plain(t) for _, t in rows], list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    for _ in rows:
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return [min(r[0] for r, c in zip(rows, comp, strict=True) if c == k) for k in comp]


def sample():
    rng, texts = random.Random(9), ["", " \n", "x y", "X  y", "one two three four five"]
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts.append(" ".join(base))
        for share in (0.01, 0.03, 0.1, 0.3):
            texts.append(" ".join(f"e{rng.randrange(4000)}" if rng.random() < share else w for w in base))
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_stage_reaches_similarity_of_four_fifths(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, "en", "web", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = cp.drop_near_duplicates(spark, df, "")
    want = set(brute(rows))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and len(want) < len(rows) - 20
    assert got.columns == df.columns and cp.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_one_row_a_group(spark):
    base = [f"w{i}" for i in range(200)]
    near, other = " ".join([*base[:100], "edit", *base[101:]]), "a text of its own with more than five words"
    rows = [(1, " ".join(base)), (2, near), (2, other), (2, other), (3, other + " "), (None, near), (None, "lone"), (None, "lone")]
    got = wide_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "lone"), (1, " ".join(base)), (2, other)]


def test_wide_fingerprint():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (5, 64))
    words = [int("".join(map(str, b)), 2) for b in bits]
    want = int("".join(str(int(c >= 3)) for c in bits.sum(0)), 2)
    assert wide_simhash.majority(*np.array(words, "uint64")[:, None])[0] == want
    base = rng.integers(0, 1 << 62, 8000, "uint64")
    assert len(wide_simhash.wide_fingerprint(base[:0])) == 0 and len(set(wide_simhash.wide_fingerprint(base).tolist())) == wide_simhash.BLOCKS
    apart, shared = [], 0
    for i in range(150):  # 80 of 90 elements in common: similarity 0.8
        own = base[i * 50 : i * 50 + 100]
        a, b = (wide_simhash.wide_fingerprint(np.sort(x)) for x in (own[:90], own[10:]))
        apart.append(int(np.bitwise_count(a ^ b).sum()))
        shared += (a == b).any()
    assert shared == 150 and max(apart) <= wide_simhash.FAR and 180 < np.mean(apart) < 300
    far = [int(np.bitwise_count(wide_simhash.wide_fingerprint(base[i : i + 90]) ^ wide_simhash.wide_fingerprint(base[i + 90 : i + 180])).sum()) for i in range(0, 3000, 90)]
    assert min(far) > wide_simhash.FAR


def family(seed, n, changes):
    rng = np.random.default_rng(seed)
    sets, base = {}, rng.integers(0, 1 << 62, 100)
    for i in range(n):
        base = base if i % 10 else rng.integers(0, 1 << 62, 100)
        own = base.copy()
        own[rng.integers(0, 100, changes)] = rng.integers(0, 1 << 62, changes)
        sets[i] = np.unique(own)
    forest = wide_simhash.Forest()
    for i, a in sets.items():
        for j in range(i):
            if similarity(set(a.tolist()), set(sets[j].tolist())) >= 0.8:
                forest.link(i, j)
    return sets, [forest.find(i) for i in sets]


def frame(spark, sets):
    rows = [(i, wide_simhash.wide_fingerprint(s.view("uint64")).view("int64").tolist(), s.tolist()) for i, s in sets.items()]
    return spark.createDataFrame(rows, "node long, fp array<long>, hashes array<long>")


def joined(sets, *links):
    got = wide_simhash.Forest()
    for found in links:
        for r in found.collect():
            got.link(r.u, r.v)
    return [got.find(i) for i in sets]


def test_parts_lose_no_link(spark):
    """Classes of every size, dealt into parts of their own and shared ones, in one component."""
    sets, want = family(4, 150, 6)
    df = frame(spark, sets)
    for classes in ({i: i for i in sets}, {i: want[i] if i < 70 else i for i in sets}, dict(enumerate(want))):
        members = spark.createDataFrame([(0, i, c, len(sets[i])) for i, c in classes.items()], "root long, node long, class long, size long")
        given = spark.createDataFrame([(i, c) for i, c in classes.items()], "u long, v long")
        for part in (3, 20, 1000):
            assert joined(sets, given, wide_simhash.class_links(members, df, 0.8, part=part)) == want
    assert len(set(want)) > 5


def test_stars_in_parts(spark):
    sets, _ = family(5, 60, 5)
    edges = [(i, i - i % 10) for i in sets if i % 10] + [(i, 0) for i in sets if i]
    want = {(u, v) for u, v in edges if similarity(set(sets[u].tolist()), set(sets[v].tolist())) >= 0.8}
    got = wide_simhash.star_links(spark.createDataFrame(edges, "u long, v long"), frame(spark, sets), 0.8, part=7).collect()
    assert {(r.u, r.v) for r in got} == want and 10 < len(want) < len(edges) - 10


def test_large_group_of_near_copies(spark):
    """A third of all rows are copies of one text with a word or two changed; strays are alike to some of them only."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(60))) for i in range(300)]
    want = sorted(set(brute(rows)))
    got = wide_simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want and 300 < len(want) < 400
