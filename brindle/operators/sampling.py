"""Reproducible samples by hash order: exact size with complement, and stratified.

Only sizes, disjointness and order are the contract; the order comes from a seeded arithmetic hash of the id, so it
doesn't depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 2^32 - 1 that looks random."""
    return F.pmod((F.pmod(key, F.lit(2_147_483_648)) + F.lit(seed)) * F.lit(2_654_435_761), F.lit(4_294_967_296))


def exact(df: DataFrame, n: int, id_col: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """n rows and all others; both empty when there are fewer than n rows.

    The last row of the sample in hash order is found as a top-n; both parts then are filters, so nothing is ordered as a whole.
    """
    key = hash_order(F.col(id_col), seed)
    last = df.select(key.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(n).agg(F.count("*").alias("n"), F.max(F.struct("h", "i")).alias("last")).first()
    if n == 0 or last["n"] < n:
        return df.limit(0), df if n == 0 else df.limit(0)
    h, i = last["last"]
    inside = (key < h) | ((key == h) & (F.col(id_col) <= i))
    return df.where(inside), df.where(~inside)


def stratified(df: DataFrame, n: int, strata: str, id_col: str, seed: int = 0) -> DataFrame:
    """At most n rows of each stratum."""
    order = Window.partitionBy(strata).orderBy(hash_order(F.col(id_col), seed), id_col)
    return df.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


def renumbered(df: DataFrame, group: str, id_col: str, new: str = "new_id") -> DataFrame:
    """Dense ids from 0 in the order of (group, id_col).

    Groups' sizes are summed by a window over groups; rows are numbered within their group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(group).orderBy(id_col)) - 1
    return df.withColumn("__k", own).join(starts, group).withColumn(new, F.col("__start") + F.col("__k")).drop("__k", "__start")
