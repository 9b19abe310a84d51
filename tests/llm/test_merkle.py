import glob
import hashlib
import os
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.llm import merkle

SF = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    row = [v.translate(str.maketrans(merkle._UPPER, merkle._LOWER)) if lower and i == 4 and v is not None else v for i, v in enumerate(row)]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    """(digests before, digests after) at each level from leaf i."""
    found = []
    for level in tree[:-1]:
        a = i // 16 * 16
        found.append((level[a:i], level[i + 1 : a + 16]))
        i //= 16
    return found


def plain(rows):
    """All columns of the result for rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            now = leaf(r, lower=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for before, after in steps:
                now = H(*before, now, *after)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, H(*[d for b, a in steps for d in b + a]), now, now == root))
    return Counter(out)


def check(spark, rows, parts=None):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    got = merkle.manifest(df.repartition(parts) if parts else df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, got.collect()))
    assert found == plain(rows)
    return found


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 700])
def test_sizes(spark, n):
    found = check(spark, [(i, "a", "en", i, f"Text {i}") for i in range(n)])
    assert sum(found.values()) == n


def test_odd_rows(spark):
    rows = [(i, f"s{i % 40}", "en", i, f"Text {i}") for i in range(300)] + [(i, "hot", "de", i, "Same") for i in range(300, 900)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (1000, None, "en", 1, ""), (1001, "", "en", 1, "UPPER"), (1002, "é", "en", 1, "ÄB é"), (1003, "z", "en", 1, "Long " * 100_000)]
    rows += [(5, "hot", "en", 7, "Again")] * 40 + [(None, "hot", "en", None, "Nobody")] * 20 + [(5, "hot", "en", 7, "Other")]
    found = check(spark, rows, 7)
    assert any(r[-1] for r in found) and any(not r[-1] for r in found)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df).count() == 0


def test_frontier_rounds_end(spark):
    """Events dealt over many tasks in any order, so that nearly every parent stays partial at first."""
    rows = spark.range(5000).select(F.lit("t").alias("tree"), F.col("id").alias("idx"), F.lit(5000).cast("long").alias("size"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    nodes = merkle.parents(rows.repartition(23, F.xxhash64("idx")))
    want = levels([hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)])
    got = {(r["level"], r["idx"]): r["digest"].hex() for r in nodes.collect()}
    assert got == {(k, i): h for k, level in enumerate(want) if k for i, h in enumerate(level)}
    assert {r["level"]: r["size"] for r in nodes.select("level", "size").collect()} == {k: len(level) for k, level in enumerate(want) if k}


def test_a_hot_source_is_ranked_in_parts(spark):
    n = 20_000
    rows = spark.range(n, numPartitions=6).select(F.when(F.col("id") % 10 > 0, "shot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("tree"), F.col("id"), F.lit(b"x").alias("leaf"))
    found = merkle.ranked(rows.repartition(6), ["id"])
    hot = found.where("tree = 'shot'")
    assert hot.agg(F.count("*"), F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()[:4] == (18_000, 0, 17_999, 18_000)
    assert found.where("size <> CASE WHEN tree = 'shot' THEN 18000 ELSE 1 END").isEmpty()
    assert hot.where("idx <> id - id div 10 - 1").isEmpty()


def test_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/documents.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(merkle.SQL)
    names = [d[0] for d in want.description]
    got = merkle.manifest(spark.read.parquet(f"{SF}/documents.parquet")).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
