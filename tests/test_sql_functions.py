"""SQL functions against the column functions, at their edges."""

import math

from pyspark.sql import functions as F

from brindle.functions import sql, vectors


def test_equal_the_column_functions(spark):
    sql.register(spark)
    sql.register(spark)
    rows = [([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([0.5, 0.5], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([1.0], None)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    same = {
        "vec_dot(a, b)": vectors.dot(a, b),
        "vec_l1(a)": vectors.l1(a),
        "vec_l2(a)": vectors.l2(a),
        "vec_normalise_l1(a)": vectors.normalise_l1(a),
        "vec_normalise_l2(a)": vectors.normalise_l2(a),
    }
    equal = {"vec_kl(a, b)": vectors.kl(a, b), "vec_kl_smoothed(a, b, 0.5D)": vectors.kl_smoothed(a, b, 0.5), "vec_js(a, b, 3D, 1D)": vectors.js(a, b, F.lit(3.0), F.lit(1.0)), "vec_distance(a, b)": vectors.distance(a, b)}
    for text, column in (same | equal).items():
        both = df if text in same else df.where("size(a) = size(b)")
        for got, want in both.select(F.expr(text), column).collect():
            assert got == want, text


def test_edges(spark):
    sql.register(spark)
    one = lambda text: spark.sql(f"SELECT {text}").first()[0]
    assert math.isinf(one("vec_distance(array(1D), array(1D, 2D))")) and one("vec_distance(NULL, array(1D))") is None
    assert one("vec_normalise_l2(array(0D, 0D))") == [0.0, 0.0]
    assert one("vec_kl(array(0.5D, 0.5D), array(1D, 0D))") == 1e20 and one("vec_kl(array(1D, 0D), array(1D, 0D))") == 0
    plan = spark.range(3).selectExpr("vec_dot(array(double(id)), array(2D)) AS d")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
