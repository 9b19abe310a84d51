"""Lookups: ids of paths with a default, id ranges of images, positional merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids_of_paths(paths: DataFrame, images: DataFrame) -> DataFrame:
    """(line, path, fid): the id of each listed path, 0 if unknown; of repeated paths in ``images`` the last line counts."""
    last = images.groupBy("path").agg(F.max_by("fid", "line").alias("fid"))
    return paths.join(last, "path", "left").select("line", "path", F.coalesce("fid", F.lit(0)).alias("fid"))


def id_ranges(keypoints: DataFrame) -> DataFrame:
    """(fid, first_id, last_id, n): every image, the last one included."""
    return keypoints.groupBy("fid").agg(F.min("kp_id").alias("first_id"), F.max("kp_id").alias("last_id"), F.count("*").alias("n"))


def merged(info: DataFrame, vectors: DataFrame) -> DataFrame:
    """Info rows with their vector."""
    return info.join(vectors, "kp_id")


def spread_join(rows: DataFrame, per_key: DataFrame, on: list[str], n: str, total: int, share: int = 1024, parts: int = 0) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row a key and in ``n`` the number of ``rows`` of that key; ``n`` stays.

    ``total`` is the number of ``rows``, or more. Keys with over ``total / share`` rows, fewer than ``share`` by that bound, are broadcast, so their
    rows stay where they are. The others are shuffled, into ``parts`` parts if given, which Spark doesn't put together; none of them brings a task more than ``total / share`` rows. Nulls in ``on`` join nothing.
    """
    large = F.col(n) * share > total
    hot, cold = per_key.where(large), per_key.where(~large)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    if parts:
        rest, cold = rest.repartition(parts, *on), cold.repartition(parts, *on)
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))
