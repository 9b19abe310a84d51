"""Scores summed where the images lie, against plain sums."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import evaluation, scores
from brindle.plans import ranking, search


def tables(spark):
    rng = random.Random(5)
    images = {f: Counter(min(int(rng.expovariate(0.1)), 60) for _ in range(rng.randint(1, 40))) for f in [None, *range(-3, 300)]}
    queries = {q: Counter(min(int(rng.expovariate(0.2)), 60) for _ in range(rng.randint(1, 30))) for q in range(90)}
    held = spark.createDataFrame([(f, f"w{w}", n) for f, c in images.items() for w, n in c.items()], "fid long, word string, n long").repartition(5)
    asked = spark.createDataFrame([(q, f"w{w}", n) for q, c in queries.items() for w, n in c.items()], "qfid long, word string, w long")
    return asked, held, {(q, f): n for q, a in queries.items() for f, b in images.items() if (n := sum(a[w] * b[w] for w in a))}


@pytest.mark.parametrize("rows", [1_000_000, 300])
@pytest.mark.parametrize("full", [4 << 20, 90 * 3])
def test_top_and_pairs(spark, monkeypatch, rows, full):
    monkeypatch.setattr(scores, "FULL", full)
    asked, held, want = tables(spark)
    got = scores.pairs(asked, held, F.col("n"), rows=rows)
    assert {(r.qfid, r.fid): r.score for r in got.collect()} == want
    best = {(r.qfid, r["rank"]): (r.fid, r.n) for r in scores.top(asked, held, 7, F.col("n"), rows=rows).collect()}
    for q in range(90):
        mine = sorted(((n, f is not None, f or 0, f) for (a, f), n in want.items() if a == q), reverse=True)[:7]
        assert [best.get((q, i + 1)) for i in range(7)] == [(x[3], x[0]) for x in mine] + [None] * (7 - len(mine))


def test_marked_votes_equal_the_counts_of_judged_votes(spark):
    asked, held, want = tables(spark)
    kinds = spark.createDataFrame([(f, "abc"[f % 3] if f % 7 else None, 1 + f % 2) for f in range(-3, 300)], "fid long, category string, times long")
    got = {(r.qid, r.mark): (r.correct, r.wrong) for r in evaluation.marked_votes(asked, held, kinds, marks=(1, 5, 40)).collect()}
    kind = lambda f: "abc"[f % 3] if f % 7 else None
    plain = {}
    for (q, f), n in want.items():
        for m in (1, 5, 40):
            if f is not None and n >= m:
                right, wrong = plain.get((q, m), (0, 0))
                own = (1 + f % 2) * (1 + q % 2) * (kind(f) is not None and kind(q) is not None)
                plain[q, m] = (right + own * (kind(f) == kind(q)), wrong + own * (kind(f) != kind(q)))
    assert got == plain


def test_no_pair_is_shuffled(spark):
    """Scores come from one pass over the images: what is left to order are the best of each task."""
    plan = ranking.ranked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.index("MapInArrow") > plan.index("Window") and "HashAggregate" not in plan


def test_simple_scores_ask_for_twenty(spark, monkeypatch):
    asked, own = [], search.ranked
    monkeypatch.setattr(search, "ranked", lambda spark, sf_dir, k=50: asked.append(k) or own(spark, sf_dir, k))
    assert search.a15(spark, "/root/testdata/sf0.001").columns and asked == [20]
