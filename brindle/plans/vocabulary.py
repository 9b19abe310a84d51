"""Queries for the vocabulary: single steps with SQL, whole runs by their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import vocabulary as v
from brindle.plans.registry import query
from brindle.plans.tables import DESCRIPTORS, descriptors
from brindle.sources import text
from brindle.sources.shared import cut, scratch

#: A fixed two-level clustering: five clusters, each with three children.
ASSIGNED = f"""{DESCRIPTORS}, assigned AS (SELECT kp_id, 1 AS level, kp_id % 5 AS cid, 0 AS parent FROM descriptors UNION ALL SELECT kp_id, 2, kp_id % 5 * 3 + (kp_id // 5) % 3, kp_id % 5 FROM descriptors)"""
NODES = f"""{ASSIGNED}, rows AS (SELECT kp_id, 0 AS level, 0 AS cid, NULL AS parent FROM descriptors UNION ALL SELECT * FROM assigned),
 cells AS (SELECT level, cid, parent, i, avg(vec[i]) AS x, count(*) AS n FROM rows JOIN descriptors USING (kp_id), unnest(range(1, 65)) AS r(i) GROUP BY ALL),
 nodes AS (SELECT row_number() OVER (ORDER BY level, coalesce(parent, -1), cid) - 1 AS node_id, level, cid, parent, max(n) AS n, list(x ORDER BY i) AS center FROM cells GROUP BY level, cid, parent),
 linked AS (SELECT a.*, b.node_id AS parent_id FROM nodes a LEFT JOIN nodes b ON b.level = a.level - 1 AND b.cid = a.parent),
 tree AS (SELECT l.*, (SELECT min(node_id) FROM linked c WHERE c.parent_id = l.node_id) AS child_lo, (SELECT max(node_id) FROM linked c WHERE c.parent_id = l.node_id) AS child_hi FROM linked l)"""
DIST = "list_sum([(p.vec[i] - c.center[i]) * (p.vec[i] - c.center[i]) for i in range(1, len(p.vec) + 1)])"


def assigned(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    one = d.select("kp_id", F.lit(1).alias("level"), (F.col("kp_id") % 5).alias("cid"), F.lit(0).cast("long").alias("parent"))
    two = d.select("kp_id", F.lit(2).alias("level"), F.expr("kp_id % 5 * 3 + (kp_id div 5) % 3").alias("cid"), (F.col("kp_id") % 5).alias("parent"))
    return one.unionByName(two)


def nodes(spark, sf_dir):
    return v.tree(assigned(spark, sf_dir), descriptors(spark, sf_dir))


@query("s10_level_edges", f"WITH {ASSIGNED} SELECT level, parent, count(DISTINCT cid) AS n_children FROM assigned GROUP BY level, parent")
def edges(spark, sf_dir):
    return v.level_edges(assigned(spark, sf_dir))


@query("s10_level_sizes", f"WITH {ASSIGNED} SELECT level, cid, count(*) AS n FROM assigned GROUP BY level, cid")
def sizes(spark, sf_dir):
    return v.level_sizes(assigned(spark, sf_dir))


@query("a10_a11_c3_tree", f"WITH {NODES} SELECT node_id, level, cid, child_lo IS NULL AS is_leaf, child_lo, child_hi, n, round(center[1], 6) AS c1, round(center[64], 6) AS c64, round(list_sum([x * x for x in center]), 6) AS norm, parent_id FROM tree")
def tree(spark, sf_dir):
    t = nodes(spark, sf_dir)
    norm = F.aggregate("center", F.lit(0.0), lambda a, x: a + x * x)
    return t.select("node_id", "level", "cid", "is_leaf", "child_lo", "child_hi", "n", F.round(F.element_at("center", 1), 6).alias("c1"), F.round(F.element_at("center", 64), 6).alias("c64"), F.round(norm, 6).alias("norm"), "parent_id")


@query("s7_s8_words", f"WITH {NODES}, {'leaves'} AS (SELECT node_id AS word, cid FROM tree WHERE level = 2) SELECT word, kp_id, fid FROM assigned a JOIN leaves USING (cid) JOIN descriptors d USING (kp_id) WHERE a.level = 2")
def words(spark, sf_dir):
    return v.postings(assigned(spark, sf_dir), nodes(spark, sf_dir), descriptors(spark, sf_dir)).select("word", "kp_id", "fid")


@query(
    "j5_t5_tree_descent",
    f"""WITH {NODES}, one AS (SELECT kp_id, vec, arg_min(c.node_id, {{'d': {DIST}, 'i': c.node_id}}) AS node FROM descriptors p JOIN tree c ON c.parent_id = 0 GROUP BY kp_id, vec),
     two AS (SELECT kp_id, arg_min(c.node_id, {{'d': {DIST}, 'i': c.node_id}}) AS word FROM one p JOIN tree c ON c.parent_id = p.node GROUP BY kp_id) SELECT kp_id, word FROM two""",
)
def descent(spark, sf_dir):
    return v.descend(descriptors(spark, sf_dir), nodes(spark, sf_dir), 2)


@query(
    "c1_lloyd_step",
    f"""WITH {DESCRIPTORS}, seeds AS (SELECT kp_id % 5 AS cid, kp_id // 5 AS id, vec AS center FROM descriptors WHERE kp_id < 20),
     a AS (SELECT p.kp_id, p.kp_id % 5 AS cid, p.vec, arg_min(c.id, {{'d': {DIST}, 'i': c.id}}) AS id FROM descriptors p JOIN seeds c ON c.cid = p.kp_id % 5 GROUP BY ALL),
     m AS (SELECT cid, id, i, avg(vec[i]) AS x, count(*) AS n FROM a, unnest(range(1, 65)) AS r(i) GROUP BY ALL)
    SELECT cid, id, max(n) AS n, round(sum(x), 6) AS total, round(sum(x * x), 6) AS norm FROM m GROUP BY cid, id""",
)
def lloyd(spark, sf_dir):
    points = descriptors(spark, sf_dir).select("kp_id", (F.col("kp_id") % 5).alias("cid"), "vec")
    # The first points are the seeds of this step; all points take part.
    seeds = points.where("kp_id < 20").select("cid", F.expr("kp_id div 5").alias("id"), F.col("vec").alias("center"))
    add = lambda f: F.round(F.aggregate("center", F.lit(0.0), f), 6)
    return v.lloyd_step(points, seeds).select("cid", "id", "n", add(lambda a, x: a + x).alias("total"), add(lambda a, x: a + x * x).alias("norm"))


@query("c2_hierarchical_vocabulary")
def hierarchy(spark, sf_dir):
    return v.hierarchy(descriptors(spark, sf_dir), k=10, levels=2, least=15, rounds=15, epsilon=0.05)


@query("c2_resumed_vocabulary")
def resumed(spark, sf_dir):
    """The second level from a written first one; tested to be that of ``c2_hierarchical_vocabulary``."""
    d, prefix, options = descriptors(spark, sf_dir), scratch(spark, "level"), {"k": 10, "least": 15, "rounds": 15, "epsilon": 0.05}
    text.write_level(cut(v.hierarchy(d, levels=1, **options)), prefix)
    return v.hierarchy(d, levels=2, start=v.resumed(text.read_level(spark, prefix), d), done=1, **options)


@query("s10_level_parts", f"""WITH {ASSIGNED}, l AS (SELECT * FROM assigned WHERE level = 2)
    SELECT 'edge' AS kind, parent AS a, count(DISTINCT cid) AS b FROM l GROUP BY parent UNION ALL SELECT 'size', cid, count(*) FROM l GROUP BY cid
    UNION ALL SELECT 'point', row_number() OVER (ORDER BY kp_id) - 1, cid FROM l""")
def level_parts(spark, sf_dir):
    """A level written and read in ordered parts."""
    prefix = scratch(spark, "level")
    text.write_level(assigned(spark, sf_dir).where("level = 2"), prefix, count=100)
    return text.read_level(spark, prefix)
