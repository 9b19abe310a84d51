import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.llm import exact


def plain(rows):
    """(doc_id, keep_id, group_size, number of rows that stay, sha256) of every (doc_id, text), in order."""
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    least = lambda d: (d is not None, d or 0)
    return sorted(((d, max(by[t or ""], key=least), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)


def check(found, rows):
    got = found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    stays = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(stays) == len({h for _, h in stays}) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_mark(spark):
    rows = [(i, f"text {i % 70}") for i in range(500)] + [(600, None), (601, ""), (None, "text 1"), (None, None), (7, "text 7"), (7, "text 7"), (800, "long " * 200_000), (801, "long " * 200_000), (802, "Text 1"), (803, "text 1 ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    check(exact.mark(df), rows)
    assert exact.mark(df).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact.mark(df.limit(0)).count() == 0 == exact.dedup(df.limit(0)).count()


def test_dedup(spark):
    rows = [(i, f"text {i % 9}" if i % 3 else "often", f"extra {i}") for i in range(300)] + [(None, "often", "n"), (None, "alone", "n"), (None, "alone", "n"), (5, "again", "a"), (5, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    kept = exact.dedup(df)
    assert kept.columns == df.columns
    got = {r.text: r.doc_id for r in kept.collect()}
    assert kept.count() == len(got) == len({t for _, t, _ in rows})
    assert got == {t: max((d for d, u, _ in rows if u == t and d is not None), default=None) for t in got}


def test_frequent_digests_are_proposed_and_verified(spark):
    n = 40_000
    text = F.when(F.col("id") % 3 == 0, "a third").when(F.col("id") % 50 == 1, "a fiftieth").otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    rows = exact.digests(spark.range(n, numPartitions=150).select("id", text.alias("text")), "text", "id", [])
    # Fewer counters than digests, so that counters are taken away and merged.
    found = exact.winners(rows, n, 100, 1024).collect()
    counts = {bytes(r["__digest"]): r["__n"] for r in found}
    want = {hashlib.sha256(t.encode()).digest(): len([i for i in range(n) if f(i)]) for t, f in (("a third", lambda i: i % 3 == 0), ("a fiftieth", lambda i: i % 3 and i % 50 == 1))}
    assert counts == want


@pytest.mark.parametrize("equal", [False, True])
def test_a_hot_text_stays_where_it_is(spark, equal):
    """90 % of the rows have one text (and, if ``equal``, one id); no task of the shuffle gets them."""
    n = 20_000
    hot = F.col("id") % 10 > 0
    df = spark.range(n, numPartitions=8).select(F.when(hot, 7).otherwise(F.col("id")).alias("doc_id") if equal else F.col("id").alias("doc_id"), F.when(hot, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    found = exact.mark(df)
    assert found.groupBy("kept").count().orderBy("kept").collect()[1][1] == n // 10 + 1
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < n // 4


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact.mark(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD"))
