"""Rounding as the SQL does it, down to the sign of zero and to sums that are equal only when rounded."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from brindle.functions.vectors import rounded
from brindle.operators import clustering
from brindle.plans import registry

registry.load()


def test_rounded_equals_sql(spark):
    rng = np.random.default_rng(3)
    values = [-1e-7, 1e-7, -0.0, 0.0, 0.5e-6, -0.5e-6, 1.5, *((rng.integers(-2_000_000, 2_000_000, 3000) * 2 + 1) / 2e6).tolist()]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v")).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [(v, math.copysign(1, v)) for v in got] == [(v, math.copysign(1, v)) for v in want]


def test_vector_queries_equal_sql_on_small_and_half_numbers(spark, tmp_path):
    rng = np.random.default_rng(4)
    vecs = (rng.integers(-9_000_000, 9_000_000, (40, 64)) * 2 + 1) / 2e6 * (rng.random((40, 64)) < 0.5) - 1e-7
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vecs)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("s3_s4_vector_file", "s13_dense_matrix", "s14_oxford_features"):
        found = con.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        want = sorted(str([r[i] for i in range(len(names))]) for r in found.fetchall())
        assert sorted(str([r[n] for n in names]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == want, name


def test_gains_are_compared_as_rounded(spark):
    points = spark.createDataFrame([(1, [2.0, 0.0], 0), (2, [2.0, 0.0], 1)], "doc_id long, vec array<double>, cluster int")
    centers = np.array([[1.0, 0.0], [1.0 + 1e-9, 0.0]])
    assert {r.doc_id: r.cluster for r in clustering.assign(points, centers, "euclidean", digits=7).collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.cluster for r in clustering.assign(points, centers, "euclidean").collect()} == {1: 1, 2: 1}
