"""The vector functions for SQL text: temporary functions with SQL bodies, so that Catalyst inlines them and no Python runs.

After ``register(spark)`` a query says ``SELECT vec_distance(a, b) FROM ...``. The values are those of ``brindle.functions.vectors``: a distance between vectors of
different dimensions is infinite, a vector of norm 0 stays as it is, a divergence from a distribution that lacks support is 1e20; null arguments give null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_V = "ARRAY<DOUBLE>"
_SUM = "aggregate({}, 0D, (s, t) -> s + t)"


def _sum(terms: str) -> str:
    return _SUM.format(terms)


#: Name, parameters, type and body, each after those it calls.
FUNCTIONS = (
    ("vec_dot", f"a {_V}, b {_V}", "DOUBLE", _sum("zip_with(a, b, (x, y) -> x * y)")),
    ("vec_squared_distance", f"a {_V}, b {_V}", "DOUBLE", f"CASE WHEN size(a) = size(b) THEN {_sum('zip_with(a, b, (x, y) -> (x - y) * (x - y))')} WHEN a IS NOT NULL AND b IS NOT NULL THEN double('infinity') END"),
    ("vec_distance", f"a {_V}, b {_V}", "DOUBLE", "sqrt(vec_squared_distance(a, b))"),
    ("vec_l1", f"v {_V}", "DOUBLE", _sum("transform(v, x -> abs(x))")),
    ("vec_l2", f"v {_V}", "DOUBLE", "sqrt(vec_dot(v, v))"),
    ("vec_scaled", f"v {_V}, by DOUBLE", _V, "CASE WHEN by > 0 THEN transform(v, x -> x / by) ELSE v END"),
    ("vec_normalise_l1", f"v {_V}", _V, "vec_scaled(v, vec_l1(v))"),
    ("vec_normalise_l2", f"v {_V}", _V, "vec_scaled(v, vec_l2(v))"),
    ("vec_kl", f"p {_V}, q {_V}", "DOUBLE", f"CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN least(1e20D, {_sum('zip_with(p, q, (x, y) -> CASE WHEN x > 0 THEN CASE WHEN y > 0 THEN x * ln(x / y) ELSE 1e20D END ELSE 0D END)')}) END"),
    ("vec_kl_smoothed", f"p {_V}, q {_V}, alpha DOUBLE", "DOUBLE", "vec_kl(p, transform(q, y -> (y + alpha / size(q)) / (1 + alpha)))"),
    ("vec_mean", f"p {_V}, q {_V}, share DOUBLE", _V, "zip_with(p, q, (x, y) -> share * x + (1 - share) * y)"),
    ("vec_js", f"p {_V}, q {_V}, wp DOUBLE, wq DOUBLE", "DOUBLE", "wp / (wp + wq) * vec_kl(p, vec_mean(p, q, wp / (wp + wq))) + wq / (wp + wq) * vec_kl(q, vec_mean(p, q, wp / (wp + wq)))"),
)


def register(spark: SparkSession) -> None:
    """Defines the functions for the session, replacing earlier ones of these names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
