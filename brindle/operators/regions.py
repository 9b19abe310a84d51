"""Regions: colour regions of segmented images, keypoints' region lists, and geometric consistency of matched regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI = 3.14159265
GROUP = ["qfid", "fid", "qseg", "seg"]


def boxes(pixels: DataFrame) -> DataFrame:
    """(fid, level, color, x1, x2, y1, y2, pixels) of pixels (fid, level, x, y, color)."""
    return pixels.groupBy("fid", "level", "color").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("pixels"))


def pruned(regions: DataFrame, width: int, height: int, alpha: float = 0.3, beta: float = 0.6, gamma: float = 0.6) -> DataFrame:
    """Regions that are neither too wide, too high nor too large; thresholds are cut to integers."""
    return regions.where((F.col("x2") - F.col("x1") <= int(width * beta)) & (F.col("y2") - F.col("y1") <= int(height * gamma)) & (F.col("pixels") <= int(width * height * alpha)))


def keypoint_colors(keypoints: DataFrame, pixels: DataFrame) -> DataFrame:
    """Keypoints (kp_id, fid, x, y) with level and color of the pixel they lie in."""
    place = keypoints.select("kp_id", "fid", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return place.join(pixels, ["fid", "x", "y"]).select("kp_id", "fid", "level", "color")


def region_ids(placed: DataFrame, kept: DataFrame, low: int = 3) -> DataFrame:
    """(fid, level, color, seg, n): kept regions with at least ``low`` keypoints, numbered from 0 in each image by level and color."""
    inside = placed.join(kept.select("fid", "level", "color"), ["fid", "level", "color"], "left_semi")
    counts = inside.groupBy("fid", "level", "color").agg(F.count("*").alias("n")).where(F.col("n") >= low)
    return counts.withColumn("seg", F.row_number().over(Window.partitionBy("fid").orderBy("level", "color")) - 1)


def keypoint_segments(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """(kp_id, fid, segs): the region ids of each keypoint in ascending order, at most one for each level; empty for none."""
    own = placed.join(ids.select("fid", "level", "color", "seg"), ["fid", "level", "color"])
    lists = own.groupBy("kp_id", "fid").agg(F.sort_array(F.collect_list("seg")).alias("segs"))
    return placed.select("kp_id", "fid").distinct().join(lists, ["kp_id", "fid"], "left").withColumn("segs", F.coalesce("segs", F.array().cast("array<int>")))


def region_pairs(queries: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Matched pairs by region pair: both sides have (fid, k, word, x, y, scl, ori, segs, tfidf); i numbers a region pair's pairs from 0.

    Keypoints without regions drop out. ``p`` is the query's side, ``q`` the matched side.
    """
    p = queries.select(F.col("fid").alias("qfid"), "word", F.struct("k", "x", "y", "scl", "ori", "tfidf").alias("p"), F.explode("segs").alias("qseg"))
    q = keypoints.select("fid", "word", F.struct("k", "x", "y", "scl", "ori", "tfidf").alias("q"), F.explode("segs").alias("seg"))
    order = Window.partitionBy(*GROUP).orderBy("p.k", "q.k")
    # By images, so that the pairs' numbers, region pairs and images all follow from one shuffle.
    return p.join(q, "word").repartition("qfid", "fid").withColumn("i", F.row_number().over(order) - 1).select(*GROUP, "i", "p", "q")


def _descents(labels: Column) -> Column:
    """Minus the number of entries of an array that are smaller than the one before."""
    n = F.size(labels)
    down = F.zip_with(F.slice(labels, 2, n), F.slice(labels, 1, n - 1), lambda now, before: (now < before).cast("int"))
    return -F.aggregate(down, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))


def _order(turned: Column, place: str, mode: str) -> Column:
    """The labels of a region pair's matches along one axis of the matched side; ``turned`` has (v, i) and ``place`` of each match.

    As written, the match at position i has for its label the number of the match whose turned coordinate ranks i; intended is its own rank.
    """
    ranked = F.array_sort(turned)
    if mode == "intended":
        own = F.array_sort(F.transform(ranked, lambda m, k: F.struct(m[place], m["i"], k.alias("label"))))
        return F.transform(own, lambda m: m["label"])
    along = F.array_sort(F.transform(turned, lambda m: F.struct(m[place], m["i"])))
    return F.transform(along, lambda m: F.get(ranked, m["i"])["i"])


def consistency(pairs: DataFrame, limit: int = 2, lam: float = 2.0, piu: float = 1.0, mode: str = "as_written", small: bool = False) -> DataFrame:
    """(group, n, dori, mg, md, mall, tfidf) of region pairs with at least ``limit`` matched pairs; with ``small`` of the others too, whose mall is 0.

    dori is the mean change of orientation weighted by mean scale; null where all scales are 0. Region pairs of fewer matches are dropped before their matches are
    gathered; the matches of one region pair, the product of two regions' keypoints of equal words at most, are ordered as arrays of a row.
    """
    scale, change = (F.col("p.scl") + F.col("q.scl")) / 2, F.col("q.ori") - F.col("p.ori")
    enough = pairs.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.round(F.try_divide(F.sum(scale * change), F.sum(scale)), 9).alias("dori"), F.sum(F.col("p.tfidf") * F.col("q.tfidf")).alias("tfidf"),
        F.collect_list(F.struct("i", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), change.alias("turn"))).alias("m"),
    ).where((F.col("n") >= limit) | F.lit(small))
    cos, sin, dori = F.cos("dori"), F.sin("dori"), F.col("dori")
    match = lambda value: F.transform("m", lambda m: F.struct(F.round(value(m["px"], m["py"]), 6).alias("v"), m["i"].alias("i"), m["qx"].alias("qx"), m["qy"].alias("qy")))
    across = _descents(_order(match(lambda x, y: x * cos - y * sin), "qx", mode))
    down = _descents(_order(match(lambda x, y: x * sin + y * cos), "qy", mode))
    squares = F.aggregate("m", F.lit(0.0), lambda total, m: total + (m["turn"] / (4 * PI) - dori / (4 * PI)) * (m["turn"] / (4 * PI) - dori / (4 * PI)))
    both = enough.select(*GROUP, "n", "dori", F.when(F.col("n") <= 1, 0.0).otherwise(-F.sqrt(squares / F.col("n"))).alias("md"), "tfidf", F.least(across, down).alias("mg"))
    mall = F.greatest(F.lit(0.0), F.col("n") + F.lit(lam) * F.col("mg") + F.lit(piu) * F.col("n") * F.col("md"))
    return both.withColumn("mall", F.when(F.col("n") >= limit, mall).otherwise(F.lit(0.0)))


def region_scores(pairs: DataFrame, consistent: DataFrame, norms: DataFrame) -> DataFrame:
    """(qfid, fid, sim): sums of mall / n x tfidf over region pairs by the matched image's norm; images whose region pairs are all too small score 0."""
    images = pairs.select("qfid", "fid").distinct()
    sums = consistent.groupBy("qfid", "fid").agg(F.sum(F.col("mall") / F.col("n") * F.col("tfidf")).alias("s"))
    return images.join(sums, ["qfid", "fid"], "left").join(norms, "fid").where("factor > 0").select("qfid", "fid", F.round(F.coalesce("s", F.lit(0.0)) / F.col("factor"), 6).alias("sim"))


def group_scores(consistent: DataFrame, norms: DataFrame) -> DataFrame:
    """(qfid, fid, sim) as ``region_scores``, from region pairs with the ``small`` ones, so that the pairs aren't read again."""
    sums = consistent.groupBy("qfid", "fid").agg(F.sum(F.col("mall") / F.col("n") * F.col("tfidf")).alias("s"))
    return sums.join(norms, "fid").where("factor > 0").select("qfid", "fid", F.round(F.coalesce("s", F.lit(0.0)) / F.col("factor"), 6).alias("sim"))
