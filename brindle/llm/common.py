"""Helpers that the operators of this folder share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.shared import cut, scratch  # noqa: F401  (for the operators)

#: Bytes of text that a Python worker holds at a time, besides the Arrow batch it was given.
SLICE_BYTES = 4 << 20


def with_fields(df: DataFrame, keep: list[str], new: list[T.StructField]) -> tuple[T.StructType, list[str]]:
    """Schema of the kept columns of ``df`` followed by ``new``, and the names that pass through: a new column replaces a kept one of its name."""
    through = [c for c in keep if c not in {f.name for f in new}]
    return T.StructType([df.schema[c] for c in through] + new), through


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cuts a batch into runs of rows with about ``most`` bytes of text each (a longer text is a run of its own)."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    at = [0, *(np.flatnonzero(np.diff(part)) + 1), n]
    for a, b in zip(at, at[1:], strict=False):
        yield batch.slice(int(a), int(b - a))


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers live on, and an executor's memory counts theirs."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of_each(df: DataFrame, kept: DataFrame, text_col: str, id_col: str, how: str = "left_semi") -> DataFrame:
    """One row of ``df`` for each (id, text_key) of ``kept``; text_key is the xxhash64 of the text, and a null id is like any other.

    Joined by ``how``; repeated rows are merged before and after the shuffle, so that none of them gathers in a task.
    """
    keys = [F.col("id").isNull().alias("__n"), F.coalesce("id", F.lit(0)).alias("__i"), F.col("text_key").alias("__k")]
    kept = kept.select(*keys, *[c for c in kept.columns if c not in ("id", "text_key")])
    own = df.withColumns({"__n": F.col(id_col).isNull(), "__i": F.coalesce(id_col, F.lit(0)), "__k": F.xxhash64(text_col)})
    on = ["__n", "__i", "__k"]
    return own.join(kept, on, how).dropDuplicates(on).drop(*on)


def starts(level: DataFrame, within: list[str], by: list[str], above: DataFrame | None = None) -> DataFrame:
    """``level`` with __before for its count n: the rows before an entry, those of earlier entries ``within`` the one above and those before that one.

    ``above`` has ``within`` and its own __before; without it there is nothing before.
    """
    window = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    own = level.withColumn("__own", F.coalesce(F.sum("n").over(window), F.lit(0))).drop("n")
    if above is None:
        return own.withColumnRenamed("__own", "__before")
    return own.join(above, within).withColumn("__before", F.col("__own") + F.col("__before")).drop("__own")
