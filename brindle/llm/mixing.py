"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target number of words. A document's expected copies are target / source size; along an
order of the source's documents the expected copies are summed, one offset is added, and a document is
taken once for every integer that the sum crosses at it. Documents go by size, so the words taken stay
close to the target.

No source is ever ordered in one task. Its documents fall into ranges of sizes, the ranges into equal sizes and these
(by doc_id) into ``SALTS`` parts, ``TOGETHER`` of them to a bundle. A window orders only the ranges of a source, the sizes of a range, the bundles of a size, the
parts of a bundle or the rows of a part; each level's starts are joined to the next one's, so a join never gathers a source either. Only the
targets are windows over all sources, one row each.

Parts of over ``LARGE`` rows (and over 1/4096 of all, so that there are fewer than 4096 of them, which are broadcast) hold rows that repeat one id, or one row without an id. They are
dealt once more, by a number of the row, into ``SALTS`` parts, and written.

Defined results: size is the number of words, 0 for null and empty texts; very long texts are counted whole. A null source is a source of
its own, the last. A source without words has target 0 and is never taken. Rows without an id are parted by a hash of
the whole row. Rows of equal order (repeated rows) are numbered in any order; as they are equal in size and key, the copies as a whole are the same. An
empty table gives an empty result. Columns
other than those named pass through ``mix`` unless they clash with one of its output columns, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, starts

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED, SALTS, TOGETHER, LARGE = 1.5, 2.0, 20_240_229, 65_536, 256, 65_536
_OUT = ("size", "source_size", "target", "taken", "copies")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(source, source_size, target, offset) from one row (source, source_size) for each source.

    Filling by weight where a source stops at ``cap`` times its size and its excess is shared again by weight
    ends at one level: sources below it are full, the others have level x weight. In the order of
    cap x size / weight, sources are full up to the first that isn't at the level its predecessors leave; from there
    on these levels fall, so the first is the highest of the levels that don't fill their source.
    The rows are one for each source, not for each document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy("full_at", "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("k", F.lit(len(weights))) + 1).cast("int"))
    level = (F.lit(share) * F.col("all_sizes") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sizes.withColumn("k", F.row_number().over(by_name) - 1)
        .withColumn("weight", own)
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("all_sizes", F.sum("source_size").over(all_rows))
        .withColumn("all_weights", F.sum("weight").over(all_rows))
        .withColumn("level", level)
        .withColumn("open", F.when(F.col("full_at") > F.col("level"), F.col("level")))
        .withColumn("level", F.max("open").over(all_rows))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))))
        .withColumn("offset", F.pmod((F.col("k") + 1) * F.lit(2_654_435_761).cast("long") + F.lit(seed).cast("long"), F.lit(4_294_967_296).cast("long")) / F.lit(4_294_967_296.0))
        .select("source", "source_size", "target", "offset")
    )


def mix(df: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", keep: list[str] | None = None, large: int = LARGE, **options) -> DataFrame:
    """``keep`` (all columns unless given) with size, source_size, target, copies (how often the mix takes the document) and taken (its words).

    The texts are read once if they aren't kept, else twice.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in _OUT or c in (text_col, source_col, id_col)]
    salt = F.coalesce(F.pmod(F.col(id_col), F.lit(SALTS)), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).cast("int")
    # A key that is never null and orders like the source: joins on it keep the partitioning of the window over it.
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))
    rows = df.select(*keep, F.col(id_col).alias("__id"), words(F.col(text_col)).alias("size"), salt.alias("__salt"), key.alias("__key"))
    if text_col not in keep:
        rows = cut(rows)
    parts = cut(rows.groupBy("__key", "size", "__salt").agg(F.count("*").alias("n")))
    bundles = parts.groupBy("__key", "size", F.expr(f"__salt div {TOGETHER}").alias("__bundle")).agg(F.sum("n").alias("n"))
    sizes = bundles.groupBy("__key", "size").agg(F.sum("n").alias("n")).withColumn("__range", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
    ranges = sizes.groupBy("__key", "__range").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    goals = targets(ranges.groupBy(F.col("__key").alias("source")).agg(F.sum("words").alias("source_size")), **options).withColumnRenamed("source", "__key")

    by_range = starts(ranges.drop("words"), ["__key"], ["__range"], goals.withColumn("__before", F.lit(0).cast("long")))
    by_size = starts(sizes, ["__key", "__range"], ["size"], by_range).drop("__range")
    by_bundle = starts(bundles, ["__key", "size"], ["__bundle"], by_size)
    placed = starts(parts.withColumn("__bundle", F.expr(f"__salt div {TOGETHER}")), ["__key", "size", "__bundle"], ["__salt"], by_bundle).drop("__bundle")
    joined = _hot_apart(rows, parts, placed, large)
    rank = F.col("__before") + F.col("__number")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    copies = (F.floor(F.col("offset") + rank * rate) - F.floor(F.col("offset") + (rank - 1) * rate)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*keep, *_OUT)


def _numbered(rows: DataFrame, placed: DataFrame, on: list[str], by: Column) -> DataFrame:
    number = Window.partitionBy(*on).orderBy(by)
    return rows.withColumn("__number", F.row_number().over(number)).join(placed, on)


def _hot_apart(rows: DataFrame, parts: DataFrame, placed: DataFrame, large: int) -> DataFrame:
    """``rows`` with the rows before their part (__before) and their number in it; large parts are dealt once more."""
    on = ["__key", "size", "__salt"]
    total = parts.agg(F.sum("n")).first()[0] or 0
    hot = parts.where(F.col("n") > max(large, total // 4096)).select(*on)  # fewer than 4096 by that bound
    by_id = F.col("__id").asc_nulls_last()
    if hot.isEmpty():
        return _numbered(rows, placed, on, by_id)
    again = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    own = cut(rows.withColumn("__again", again).join(F.broadcast(hot), on))
    begin = starts(own.groupBy(*on, "__again").agg(F.count("*").alias("n")), on, ["__again"], placed)
    rest = _numbered(rows.join(F.broadcast(hot), on, "left_anti"), placed, on, by_id)
    return rest.unionByName(_numbered(own, begin, [*on, "__again"], by_id).drop("__again"))


def take(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as ``mix`` takes it, with the columns of ``df``."""
    own = {c: f"__own_{c}" for c in df.columns if c in _OUT}
    few = mix(df.withColumnsRenamed(own), id_col=id_col, **options)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return few.where("copies > 0").withColumn("__copy", copies).select(*[F.col(own.get(c, c)).alias(c) for c in df.columns])


#: The same rows by DuckDB, from a table documents.
SQL = f"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
 g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
 k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM g),
 w AS (SELECT *, CASE k % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END::DOUBLE AS weight FROM k),
 m AS (SELECT *, {CAP}::DOUBLE * source_size AS most, {CAP}::DOUBLE * source_size / weight AS full_at, (SELECT sum(size) FROM s)::DOUBLE AS all_sizes, sum(weight) OVER () AS all_weights FROM w),
 l AS (SELECT *, ({SHARE}::DOUBLE * all_sizes - coalesce(sum(most) OVER b, 0)) / (all_weights - coalesce(sum(weight) OVER b, 0)) AS level
       FROM m WINDOW b AS (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT *, max(CASE WHEN full_at > level THEN level END) OVER () AS open FROM l),
 t AS (SELECT source, source_size, CASE WHEN open IS NULL THEN most ELSE least(most, open * weight) END AS target,
        (((k + 1) * 2654435761 + {SEED}) % 4294967296) / 4294967296.0::DOUBLE AS u FROM o),
 r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(((doc_id % {SALTS}) + {SALTS}) % {SALTS}, 0), doc_id NULLS LAST) AS rank FROM s)
SELECT r.doc_id, r.size, t.source_size, t.target,
 size * CAST(floor(u + rank * coalesce(target / nullif(source_size, 0), 0)) - floor(u + (rank - 1) * coalesce(target / nullif(source_size, 0), 0)) AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
