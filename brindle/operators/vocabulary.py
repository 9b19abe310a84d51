"""Hierarchical vocabulary: k-means of every cluster of a level at once, the tree of nodes, and descent through it.

A level's clusters are all refined in the same distributed rounds: each point is joined with the centers of its own
cluster (at most K of them), and new centers are averages by (cluster, center, position). No cluster is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.vectors import squared_distance
from brindle.sources.shared import cut
from brindle.sources.text import numbered


def mean_vectors(points: DataFrame, by: list[str], vec_col: str = "vec") -> DataFrame:
    """(by, n, center): sizes and mean vectors, summed by position before anything is gathered."""
    cells = points.select(*by, F.posexplode(vec_col).alias("pos", "x"))
    means = cells.groupBy(*by, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    whole = means.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return whole.select(*by, "n", F.transform("c", lambda s: s["x"]).alias("center"))


def nearest_center(vec: Column, centers: Column) -> Column:
    """The id of the nearest of an array of (id, center); of equal distances the lowest id."""
    return F.array_min(F.transform(centers, lambda c: F.struct(squared_distance(vec, c["center"]).alias("d"), c["id"].alias("id"))))["id"]


def assign(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Points (kp_id, cid, vec) with k, the nearest of the centers (cid, id, center) of their cluster."""
    lists = centers.groupBy("cid").agg(F.collect_list(F.struct("id", "center")).alias("centers"))
    return points.join(lists, "cid").withColumn("k", nearest_center(F.col("vec"), F.col("centers"))).drop("centers")


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(cid, id, n, center): the centers after one assignment; centers without points drop out."""
    return mean_vectors(assign(points, centers).withColumnRenamed("k", "id"), ["cid", "id"])


def split_level(points: DataFrame, k: int, least: int, rounds: int, epsilon: float, seed: int) -> DataFrame:
    """Points (kp_id, cid, vec) with the new cid of one more level.

    A cluster of ``least`` points or fewer stays as one child; others get min(k, ceil(size / least)) centers. Labels are random at
    first; a center that loses its points is set on one of the cluster's points chosen by hash; what is empty at the end is dropped. Rounds
    end when no center moves by ``epsilon``.
    """
    sizes = points.groupBy("cid").agg(F.count("*").alias("size"))
    parts = sizes.select("cid", F.when(F.col("size") <= least, 1).otherwise(F.least(F.lit(k), F.ceil(F.col("size") / least))).cast("int").alias("parts"))
    sized = cut(points.join(parts, "cid"))
    first = sized.withColumn("id", F.pmod(F.xxhash64("kp_id", F.lit(seed)), F.col("parts")).cast("int"))
    centers = cut(mean_vectors(first, ["cid", "id"]))
    for r in range(rounds):
        moved = lloyd_step(sized.select("kp_id", "cid", "vec"), centers.select("cid", "id", "center")).select("cid", "id", "center")
        wanted = parts.select("cid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("id"))
        lost = wanted.join(moved, ["cid", "id"], "left_anti")
        spare = sized.groupBy("cid").agg(F.min_by("vec", F.xxhash64("kp_id", F.lit(seed + r + 1))).alias("center"))
        new = cut(moved.unionByName(lost.join(spare, "cid").select("cid", "id", "center")))
        old = centers.select("cid", "id", F.col("center").alias("old"))
        shift = new.join(old, ["cid", "id"], "left").agg(F.max(F.coalesce(squared_distance(F.col("center"), F.col("old")), F.lit(float("inf"))))).first()[0]
        centers = new
        if shift is None or shift < epsilon * epsilon:
            break
    placed = assign(sized.select("kp_id", "cid", "vec"), centers.select("cid", "id", "center"))
    used = placed.select("cid", "k").distinct()
    order = Window.orderBy("cid", "k")  # over clusters, not points
    numbered = used.withColumn("new", (F.row_number().over(order) - 1).cast("long"))
    return placed.join(numbered, ["cid", "k"]).select("kp_id", F.col("new").alias("cid"), "vec", F.col("cid").alias("parent"))


def hierarchy(descriptors: DataFrame, k: int = 10, levels: int = 1, least: int = 15, rounds: int = 15, epsilon: float = 100.0, seed: int = 1, start: DataFrame | None = None, done: int = 0) -> DataFrame:
    """(kp_id, level, cid, parent): the cluster of every point on levels 1 to ``levels``; level 0 is one cluster with id 0.

    With ``start``, the clusters (kp_id, cid) of level ``done`` of an earlier run, only the levels after it are built; they are those of a run in one go.
    """
    points = descriptors.select("kp_id", F.lit(0).cast("long").alias("cid"), "vec") if start is None else descriptors.select("kp_id", "vec").join(start.select("kp_id", "cid"), "kp_id")
    out = None
    for level in range(done + 1, levels + 1):
        points = cut(split_level(points.select("kp_id", "cid", "vec"), k, least, rounds, epsilon, seed + 1000 * level))
        rows = points.select("kp_id", F.lit(level).alias("level"), "cid", "parent")
        out = rows if out is None else out.unionByName(rows)
    return out


def resumed(level: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(kp_id, cid) from the rows (kind, a, b) of a level file: its points in the order of kp_id. Raises if the file is of other descriptors, or its sizes aren't those of its points."""
    points = level.where("kind = 'point'").select(F.col("a").alias("__position"), F.col("b").alias("cid"))
    found = cut(numbered(descriptors.select("kp_id"), "kp_id", "__position").join(points, "__position", "full").select("kp_id", "cid"))
    sizes = level.where("kind = 'size'").select(F.col("a").alias("cid"), F.col("b").alias("n"))
    own = found.groupBy("cid").agg(F.count("*").alias("own"))
    wrong = own.join(sizes, "cid", "full").where("cid IS NULL OR NOT own <=> n")
    if not found.where("kp_id IS NULL OR cid IS NULL").isEmpty() or not wrong.isEmpty():
        raise ValueError("the level file doesn't fit the descriptors")
    return found


def level_edges(assigned: DataFrame) -> DataFrame:
    """(level, parent, n_children)"""
    return assigned.groupBy("level", "parent").agg(F.countDistinct("cid").alias("n_children"))


def level_sizes(assigned: DataFrame) -> DataFrame:
    """(level, cid, n)"""
    return assigned.groupBy("level", "cid").agg(F.count("*").alias("n"))


def tree(assigned: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(node_id, level, cid, is_leaf, child_lo, child_hi, n, center, parent_id) of all nodes; node 0 is the root.

    Nodes are numbered level by level by cluster id; children of a node, numbered in the order of their parents, are one range.
    """
    root = assigned.where("level = 1").select("kp_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cid"), F.lit(None).cast("long").alias("parent"))
    rows = root.unionByName(assigned)
    nodes = mean_vectors(rows.join(descriptors.select("kp_id", "vec"), "kp_id"), ["level", "cid", "parent"])
    order = Window.orderBy("level", F.coalesce("parent", F.lit(-1)), "cid")  # over nodes
    named = nodes.withColumn("node_id", (F.row_number().over(order) - 1).cast("long"))
    parents = named.select((F.col("level") + 1).alias("level"), F.col("cid").alias("parent"), F.col("node_id").alias("parent_id"))
    linked = named.join(parents, ["level", "parent"], "left")
    ranges = linked.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.min("node_id").alias("child_lo"), F.max("node_id").alias("child_hi"))
    joined = linked.join(ranges.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    return joined.select("node_id", "level", "cid", F.col("child_lo").isNull().alias("is_leaf"), "child_lo", "child_hi", "n", "center", "parent_id")


def descend(points: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(kp_id, word): the leaf each vector reaches from the root by the nearest child; of equal distances the lowest node."""
    children = nodes.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.collect_list(F.struct(F.col("node_id").alias("id"), "center")).alias("children"))
    at = points.select("kp_id", "vec", F.lit(0).cast("long").alias("word"))
    for _ in range(levels):
        at = at.join(children, at["word"] == children["parent_id"], "left").select("kp_id", "vec", F.coalesce(nearest_center(F.col("vec"), F.col("children")), "word").alias("word"))
    return at.select("kp_id", "word")


def postings(assigned: DataFrame, nodes: DataFrame, keypoints: DataFrame) -> DataFrame:
    """(word, kp_id, fid): the inverted list of the last level's nodes."""
    last = assigned.agg(F.max("level")).first()[0]
    leaves = nodes.where(F.col("level") == last).select(F.col("cid"), F.col("node_id").alias("word"))
    return assigned.where(F.col("level") == last).join(leaves, "cid").select("word", "kp_id").join(keypoints.select("kp_id", "fid"), "kp_id")
