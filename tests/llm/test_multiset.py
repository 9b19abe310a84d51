import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from brindle.llm import multiset as ms


def plain_fingerprint(text):
    """Lane sums in Python integers."""
    lanes = [0] * ms.LANES
    for p in (text or "").split("\n"):
        if not p:
            continue
        h = hashlib.blake2b(p.encode(), digest_size=64).digest()
        for k in range(16):
            lanes[k] += int.from_bytes(h[4 * k : 4 * k + 4], "little")
        for s in re.split(r"(?<=[.!?])\s+", p):
            bits = int.from_bytes(xxhash.xxh128_digest(s.encode()), "big")
            for k in range(128):
                lanes[16 + k] += 1 if bits >> (127 - k) & 1 else -1
    return [x % 2**32 for x in lanes]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([v - 2**32 if v >> 31 else v for v in f[16:]] for f in (a, b))
    dot, size = sum(i * j for i, j in zip(x, y, strict=True)), sum(i * i for i in x) + sum(j * j for j in y)
    found = 2 * dot / size if size else 0
    return min(1.0, found) if found >= 2 / 128**0.5 else 0.0


def form(lanes):
    return "".join(f"{x:08x}" for x in lanes)


def test_homomorphism():
    a, b, c = "one line", "another. With two sentences", "third"
    fp = ms.fingerprint(f"{a}\n{b}\n{c}")
    assert (fp == ms.fingerprint(f"{c}\n\n{a}\n{b}")).all()
    assert (ms.insert(ms.fingerprint(f"{a}\n{c}"), b) == fp).all() and (ms.delete(fp, b) == ms.fingerprint(f"{c}\n{a}")).all()
    assert (fp != ms.fingerprint(f"{a}\n{b}\n{b}\n{c}")).any()
    assert (ms.from_text(ms.text_form(fp)) == fp).all() and len(ms.text_form(fp)) == 8 * ms.LANES
    assert (fp != ms.fingerprint(f"{a}\nanother.\nWith two sentences\n{c}")).any()  # the same sentences in other paragraphs
    assert ms.likeness(ms.fingerprint("x"), ms.fingerprint("x\nx")) < 1 and ms.likeness(ms.fingerprint(""), ms.fingerprint(None)) == 1
    assert ms.likeness(fp, fp) == 1 and ms.likeness(fp, ms.fingerprint("")) == 0


def test_against_a_plain_version():
    rng, before = random.Random(6), ""
    for n in [0, 1, 2, 5, 40, 300, 9000]:
        text = "".join(rng.choice(["A b c. ", "Who? ", "x\n", "é.\n", "\n\n", f"{rng.randrange(99)} "]) for _ in range(n))
        assert ms.text_form(ms.fingerprint(text)) == form(plain_fingerprint(text))
        assert ms.likeness(ms.fingerprint(text), ms.fingerprint(before)) == pytest.approx(plain_likeness(plain_fingerprint(text), plain_fingerprint(before)))
        before = text


def test_likeness_estimates_shared_sentences():
    rng, off = random.Random(7), []
    for _ in range(300):
        n = rng.choice([4, 20, 100, 1000])
        a = [f"sentence {rng.random()}." for _ in range(n)]
        keep = rng.choice([n, n // 2, 3 * n // 4, n - 1])
        b = a[:keep] + [f"other {rng.random()}." for _ in range(n - keep)]
        x, y = Counter(a), Counter(b)
        true = 2 * sum(x[s] * y[s] for s in x) / sum(v * v for c in (x, y) for v in c.values())
        off.append(ms.likeness(ms.fingerprint(" ".join(a)), ms.fingerprint(" ".join(b[: n // 2]) + "\n" + " ".join(b[n // 2 :]))) - true)
    assert np.sqrt(np.mean(np.square(off))) < 0.09 and abs(np.mean(off)) < 0.02
    lone = [ms.likeness(*(ms.fingerprint(" ".join(f"{rng.random()}." for _ in range(50))) for _ in range(2))) for _ in range(300)]
    assert np.mean(np.array(lone) > 0) < 0.06


def rows(n):
    rng = random.Random(4)
    out = [(rng.randrange(10**6), "\n".join("é" * rng.randint(0, 9) + str(rng.randrange(50)) for _ in range(rng.randint(0, 12)))) for _ in range(n)]
    return out


@pytest.mark.parametrize("n,ranges", [(0, 8), (1, 8), (2, 8), (300, 1), (300, 16), (300, 1024)])
def test_rows(spark, n, ranges):
    data = sorted(dict(rows(n)).items())
    if n > 10:
        data[5] = (data[5][0], None)
        data = [(None, "no id"), *data]
    df = spark.createDataFrame([(*r, "f") for r in data], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r.doc_id: r for r in ms.with_edited(df, ranges=ranges).collect()}
    assert len(got) == len(data)
    for k, (i, t) in enumerate(data):
        t, nxt = t or "", data[(k + 1) % len(data)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        r, own, changed = got[i], plain_fingerprint(t), plain_fingerprint(new)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == form(own) and r.edited_fingerprint == form(changed)
        assert r.near_edited == pytest.approx(plain_likeness(own, changed)) and r.near_next == pytest.approx(plain_likeness(own, plain_fingerprint(nxt)))


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb")] * 40 + [(2, "c")] * 3, "doc_id long, text string")
    assert ms.with_edited(df, ranges=4).count() == 43
    assert ms.fingerprints(df).distinct().count() == 2


def test_many_rows_without_an_id(spark):
    """Nine tenths of the rows have no id: they are dealt by their text's hash and follow each other in its order."""
    data = [(None, f"text {i}.") for i in range(360)] + [(i, f"named {i}.") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    hashed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted((t for i, t in data if i is None), key=hashed.get) + [t for i, t in data if i is not None]
    got = ms.with_edited(df, ranges=20)
    want = sorted(hashlib.sha256(ms.edited(t, order[(k + 1) % len(order)]).encode()).hexdigest() for k, t in enumerate(order))
    assert sorted(r.edited_sha256 for r in got.collect()) == want
