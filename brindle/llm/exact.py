"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Texts are equal when they are identical; they go by their SHA-256. Of equal texts the row with the largest id stays.

Digests that may be frequent come from a Misra-Gries sketch: every task keeps ``TRACKED`` counters, and the tasks' sketches are merged
in groups of ``TOGETHER``, level by level. The sketch only proposes. Its digests are counted exactly (partial counts leave each task), and those
with over ``total / share`` rows, fewer than ``share`` by that bound, are broadcast with their winner: their rows are judged where they are. The
other digests are shuffled, and none of them brings a task more than ``total / share`` rows. A digest that the sketch missed would be
judged by the shuffle all the same.

Defined results: null counts as empty, so null and empty texts are one group. A null id is less than any other. Of repeated rows (equal in
id and text) exactly one stays. Very long texts are hashed whole. An empty table gives an empty result. Kept columns pass through
``mark``; an output column replaces a kept one of its name. All columns pass through ``dedup``, whatever their names but those that begin
with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import scratch

#: Counters of a sketch; it finds every digest of over about 7 / TRACKED of all rows, so TRACKED is 16 times ``share`` at least.
TRACKED, TOGETHER, SHARE, MOST = 16_384, 64, 1024, 32_768
_OUT = ("keep_id", "group_size", "kept", "text_sha256")


def digests(df: DataFrame, text_col: str, id_col: str, keep: list[str]) -> DataFrame:
    """(keep, __id, __digest, __row), written once: the SHA-256 of the text in bytes and a number of the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*keep, F.col(id_col).alias("__id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("__digest"), F.monotonically_increasing_id().alias("__row"))
    folder = scratch(df.sparkSession, "digests")
    rows.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def frequent(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(__key): the xxhash64 of every digest that a Misra-Gries sketch of ``tracked`` counters holds for frequent."""
    task = F.expr(f"spark_partition_id() div {TOGETHER}")
    level = rows.select(F.xxhash64("__digest").alias("__key"), task.alias("__task")).groupBy("__task").agg(F.expr(f"approx_top_k_accumulate(__key, {tracked})").alias("__sketch"))
    for _ in range(2):
        level = level.groupBy(F.expr(f"__task div {TOGETHER}").alias("__task")).agg(F.expr(f"approx_top_k_combine(__sketch, {tracked})").alias("__sketch"))
    # Grouped by a constant: without rows there is no sketch to combine.
    found = level.groupBy(F.lit("all").alias("__all")).agg(F.expr(f"approx_top_k_combine(__sketch, {tracked})").alias("__sketch")).selectExpr(f"inline(approx_top_k_estimate(__sketch, {tracked}))")
    return found.select(F.col("item").alias("__key"))


def winners(rows: DataFrame, total: int, share: int, tracked: int = TRACKED) -> DataFrame:
    """(__digest, __n, __win): exact count and winner of each digest of over ``total / share`` rows that the sketch proposes."""
    proposed = rows.join(F.broadcast(frequent(rows, tracked)), F.xxhash64("__digest") == F.col("__key"), "left_semi")
    return proposed.groupBy("__digest").agg(F.count("*").alias("__n"), F.max(F.struct("__id", "__row")).alias("__win")).where(F.col("__n") * share > total)


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with __n and __win, the size and the winner of each row's group; and the winners that were broadcast."""
    spark = rows.sparkSession
    share = min(MOST, max(SHARE, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    folder = scratch(spark, "winners")
    winners(rows, rows.count(), share, 16 * share).write.parquet(folder)
    hot = spark.read.parquet(folder)
    judged = rows.join(F.broadcast(hot), "__digest")
    group = Window.partitionBy("__digest")
    rest = rows.join(F.broadcast(hot.select("__digest")), "__digest", "left_anti")
    rest = rest.withColumns({"__n": F.count("*").over(group), "__win": F.max(F.struct("__id", "__row")).over(group)})
    return judged.unionByName(rest), hot


def mark(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text unless given) with keep_id, group_size, kept and text_sha256, for every row."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in _OUT and (c != text_col or keep is not None)]
    judged, _ = _judged(digests(df, text_col, id_col, keep))
    return judged.select(
        *keep, F.col("__win.__id").alias("keep_id"), F.col("__n").alias("group_size"),
        (F.col("__win.__row") == F.col("__row")).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with its columns.

    Losers of the frequent groups are removed where they are, before any text moves; the others' texts are shuffled once.
    """
    judged, hot = _judged(digests(df, text_col, id_col, []))
    key = [F.col("__id").isNull().alias("__null"), F.coalesce("__id", F.lit(0)).alias("__key"), "__digest"]
    kept = judged.where("__win.__row = __row").select(*key)
    own = df.withColumns({"__id": F.col(id_col), "__digest": F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))})
    own = own.join(F.broadcast(hot.select("__digest", F.col("__win.__id").alias("__stays"), F.lit(True).alias("__hot"))), "__digest", "left")
    own = own.where("__hot IS NULL OR __stays <=> __id")
    own = own.select(*df.columns, *key)
    on = ["__null", "__key", "__digest"]
    return own.join(kept, on, "left_semi").dropDuplicates(on).select(*df.columns)


#: The same rows by DuckDB, from a table documents.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
