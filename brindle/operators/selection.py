"""The best keypoints of an image by normalised contrast and curvature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _normalised(df: DataFrame, name: str, value: Column, group: str) -> DataFrame:
    """((x - mean) / root of the sum of squares + 1) / 2 within each group; the root counts as 1 where it is 0."""
    w = Window.partitionBy(group)
    df = df.withColumn(name, value).withColumn("__d", F.col(name) - F.avg(name).over(w))
    size = F.sqrt(F.sum(F.col("__d") * F.col("__d")).over(w))
    return df.withColumn("__s", size).withColumn(name, (F.col("__d") / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")) + 1) / 2).drop("__d", "__s")


def best_keypoints(keypoints: DataFrame, most: int, weight: float = 0.5, group: str = "fid", id_col: str = "kp") -> DataFrame:
    """The ``most`` keypoints of each image with the least weighted score; equal scores by id."""
    both = _normalised(_normalised(keypoints, "__a", 1 / F.col("contr"), group), "__b", F.col("rpc").cast("double"), group)
    scored = both.withColumn("score", F.round(F.lit(weight) * F.col("__a") + F.lit(1 - weight) * F.col("__b"), 6)).drop("__a", "__b")
    order = Window.partitionBy(group).orderBy("score", id_col)
    return scored.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k")
