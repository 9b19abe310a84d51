import random

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing


def fill(sizes, weights, share, cap):
    """Targets by sharing the excess again until none is above."""
    goal, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        total = sum(weights[s] for s in sizes if s not in full)
        goal = {s: cap * sizes[s] if s in full else left * weights[s] / total for s in sizes}
        above = {s for s in sizes if s not in full and goal[s] > cap * sizes[s]}
        if not above:
            return goal
        full |= above


ROWS = [(i, "w " * (i % 37 + (200 if i % 50 == 0 else 1)), f"s{i % 7 if i % 3 else 0}", 7) for i in range(1500)]
ROWS += [(2000, None, "s1", 1), (2001, "", None, 1), (2002, "a b", None, 1), (2002, "a b", None, 1), (None, "x y z", "s2", 1), (2003, " \t", "empty", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int").repartition(5)


def test_rows(spark, docs, tmp_path):
    got = sorted((tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    docs.drop("size").write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted((tuple(r) for r in con.execute(mixing.SQL).fetchall()), key=str)
    assert len(got) == len(ROWS)
    assert [(a[0], a[1], a[2], a[4]) for a in got] == [(a[0], a[1], a[2], a[4]) for a in want]
    assert [a[3] for a in got] == pytest.approx([a[3] for a in want])


def test_law(docs):
    rows = mixing.mix(docs).collect()
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        target[r.source] = r.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_targets(spark):
    rng = random.Random(8)
    for k in range(12):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 100, 1000, 5000]) * rng.randint(1, 9) for i in range(rng.randint(1, 15))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = fill(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}, 1.5, 2.0)
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(want)


def test_take(docs):
    rows = mixing.mix(docs).collect()
    assert mixing.take(docs).count() == sum(r.copies for r in rows)
    assert mixing.take(docs).columns == docs.columns
    assert {r.size for r in mixing.take(docs).select("size").collect()} <= {1, 7}
    assert mixing.take(docs.limit(0)).count() == 0


def test_plan_is_native(docs, capsys):
    mixing.mix(docs).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "ArrowEval"))


def test_most_rows_without_an_id(spark):
    rows = [(None, "w " * (i % 3), "a") for i in range(900)] + [(i, "w " * (i % 5), "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df, keep=["doc_id", "source"]).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in got}
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 4 for s in "ab")
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, keep=["doc_id", "source"]).collect()))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_equal_rows_are_spread(spark, doc_id):
    """90 % of the rows are equal, without an id or with one: no task orders them all, the copies are right, reruns agree."""
    rows = [(doc_id, "a b c", "a")] * 9000 + [(100 + i, "w " * (i % 5), "ab"[i % 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    # So small a table would be put together or broadcast.
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        found = mixing.mix(df, keep=["doc_id", "source"], large=500)
        got = found.collect()
        tasks = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        for k in small:
            spark.conf.unset(k)
    # Rows in the hot part and others are in partitions of their own.
    assert max(tasks) < 3 * 9000 / 4 and len(got) == 10_000
    taken, target = {}, {r.source: r.target for r in got}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 4 for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, keep=["doc_id", "source"], large=500).collect()))
    plain = mixing.mix(df, keep=["doc_id", "source"]).collect()
    assert {s: sum(r.copies for r in plain if r.source == s) for s in taken} == {s: sum(r.copies for r in got if r.source == s) for s in taken}
    assert mixing.take(df, large=500).count() == sum(r.copies for r in got)
