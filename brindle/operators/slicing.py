"""Slices of descriptor and info tables by dense keypoint id; never by limit, whose order isn't defined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.vectors import truncated


def vector_slice(descriptors: DataFrame, offset: int, n: int) -> DataFrame:
    return descriptors.where(F.col("kp_id").between(offset, offset + n - 1))


def info_slice(info: DataFrame, offset: int, n: int) -> DataFrame:
    """The slice with ids from 0."""
    return vector_slice(info, offset, n).withColumn("kp_id", F.col("kp_id") - offset)


def text_rows(descriptors: DataFrame, offset: int = 0, n: int = 0) -> DataFrame:
    """(kp_id, line): whole-number rows as text; n = 0 takes all from the offset on."""
    some = descriptors.where(F.col("kp_id") >= offset) if n == 0 else vector_slice(descriptors, offset, n)
    return some.select("kp_id", F.array_join(truncated(F.col("vec")).cast("array<string>"), " ").alias("line"))


def text_header(rows: DataFrame) -> DataFrame:
    """(n, cols) of text rows."""
    return rows.agg(F.count("*").alias("n"), F.max(F.size(F.split("line", " "))).alias("cols"))
