"""Every query of the library against its SQL on the smallest tables, and the entry points."""

import glob
import math
import os

import duckdb
import pytest

from brindle.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got or name in registry.ORACLES
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_stream_scoring_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from brindle.operators import bow
    from brindle.plans.tables import postings
    from brindle.streaming import scoring

    weighted = bow.weights(bow.term_counts(postings(spark, SF).where("fid < 40")))
    norms = bow.factors(weighted)
    rows = weighted.where("fid < 3").select(F.col("fid").alias("qfid"), "word", "n", "tfidf", F.lit("2024-01-01 00:01:00").cast("timestamp").alias("ts"))
    late = rows.limit(1).withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    late.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    scoring.start(scoring.score_stream(stream, weighted, norms), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = {(r.qfid, r.fid): r.sim for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.qfid, r.fid): r.sim for r in bow.similarities(weighted.where("fid < 3"), weighted, norms).collect()}
    assert got == pytest.approx(want, abs=2e-6) and got
