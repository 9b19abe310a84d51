import bisect
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import sharding


def plain_fit(sizes, capacity):
    open_bins, out, n = [], [], 0
    for s in sizes:
        if s > capacity:
            out.append(n)
            n += 1
            continue
        i = bisect.bisect_left(open_bins, (s, -1))
        if i < len(open_bins):
            r, k = open_bins.pop(i)
        else:
            r, k, n = capacity, n, n + 1
        if r > s:
            bisect.insort(open_bins, (r - s, k))
        out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.integers(1, 100))
def test_best_fit(sizes, capacity):
    sizes.sort(reverse=True)
    assert sharding.best_fit(sizes, capacity) == plain_fit(sizes, capacity)


def test_tree_stays_balanced():
    bins, rng = sharding.Bins(), random.Random(1)
    held = set()
    for i in range(5000):
        if held and rng.random() < 0.4:
            k = rng.choice(sorted(held)[:50])
            bins.remove(k)
            held.discard(k)
        else:
            bins.add(i, i)
            held.add((i, i))
    assert 2 ** (bins.level[bins.root] - 1) <= len(held) + 1
    assert bins.tightest(0) == min(held)


def test_pack_shards():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 500) for _ in range(2000)), reverse=True)
    loads = [0] * 8
    for s, b in zip(sizes, sharding.pack_shards(sizes, 8), strict=True):
        loads[b] += s
    assert max(loads) - min(loads) <= 8 * 2
    loads = [0] * 8
    big = [10**6, *sizes]
    for s, b in zip(big, sharding.pack_shards(big, 8), strict=True):
        loads[b] += s
    assert loads[0] == 10**6 and max(loads[1:]) - min(loads[1:]) <= 8 * 2
    assert sharding.pack_shards([], 8) == [] and sharding.pack_shards([5], 8) == [0]


@pytest.mark.parametrize("options", [{}, {"shards": None, "capacity": 3000}])
def test_rows(spark, options):
    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 90) + str(i % 400) for i in range(900)] + ["copy " * 9] * 300 + [None, "", ""]
    df = spark.createDataFrame([(i if i % 97 else None, t, "k", 3) for i, t in enumerate(texts)], "doc_id long, text string, shard string, n int").repartition(6)
    rows = sharding.shard(df, keep=["doc_id", "text", "n"], **options).collect()
    assert len(rows) == len(texts)
    by, group, loads = {}, {}, {}
    for r in rows:
        data = (r.text or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        by.setdefault(r.shard, []).append(r.slot)
        group.setdefault(data, set()).add(r.shard)
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for s in group.values())
    if not options:
        assert set(by) == set(range(8)) and max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values())
    else:
        assert max(loads.values()) <= max(3000, 46 * 300) and len(loads) <= 2 * sum(loads.values()) // 3000
    assert sharding.shard(df.limit(0), **options).count() == 0


def test_one_group_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 50)
    monkeypatch.setattr(sharding, "TASK_GROUPS", 20)
    rows = [(None if i % 3 else i, "") for i in range(900)] + [(i, f"text {i}") for i in range(100)] + [(7, "again")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r["size"] == 1}) == 1


def test_rows_of_one_id_are_numbered_in_parts(spark, monkeypatch):
    """90 % equal rows, id and text alike: their parts stay near PART_ROWS."""
    monkeypatch.setattr(sharding, "PART_ROWS", 200)
    df = spark.createDataFrame([(7, "hot")] * 9000 + [(100 + i, f"text {i}") for i in range(1000)], "doc_id long, text string").repartition(8)
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        found = sharding.shard(df)
        rows = found.collect()
        tasks = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert max(tasks) < 3 * 10_000 / 16
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 10_000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
