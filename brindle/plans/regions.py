"""Queries for regions. Searches ask for every image whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import bow, regions
from brindle.plans.registry import query
from brindle.plans.tables import KEYPOINTS, keypoints, read
from brindle.sources.shared import cut

WIDTH, HEIGHT = 64, 48
PIXELS = """pixels AS (SELECT fid, level, x, y, min(color) AS color FROM (SELECT l_orderkey % 50 AS fid, l_linenumber % 4 + 2 AS level, l_partkey % 64 AS x, l_suppkey % 48 AS y,
   CASE WHEN l_quantity < 3 THEN 7 ELSE ((l_partkey % 64) // 16) * 3 + (l_suppkey % 48) // 16 + 100 END AS color FROM lineitem) GROUP BY ALL)"""
BOXES = f"{PIXELS}, boxes AS (SELECT fid, level, color, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, count(*) AS pixels FROM pixels GROUP BY ALL), kept AS (SELECT * FROM boxes WHERE x2 - x1 <= 38 AND y2 - y1 <= 28 AND pixels <= 921)"
SEGMENTS = f"""{BOXES}, kps AS (SELECT o_orderkey AS kp_id, o_custkey % 50 AS fid, o_totalprice - floor(o_totalprice / 64) * 64 AS x, (o_orderkey % 48) + 0.5 AS y FROM orders),
 placed AS (SELECT kp_id, k.fid, level, color FROM kps k JOIN pixels p ON p.fid = k.fid AND p.x = CAST(floor(k.x) AS BIGINT) AND p.y = CAST(floor(k.y) AS BIGINT)),
 ids AS (SELECT fid, level, color, n, row_number() OVER (PARTITION BY fid ORDER BY level, color) - 1 AS seg FROM (SELECT fid, level, color, count(*) AS n FROM placed SEMI JOIN kept USING (fid, level, color) GROUP BY ALL HAVING count(*) >= 3))"""


def pixels(spark, sf_dir):
    color = F.when(F.col("l_quantity") < 3, F.lit(7).cast("long")).otherwise(F.expr("((l_partkey % 64) div 16) * 3 + (l_suppkey % 48) div 16 + 100"))
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("fid"), (F.col("l_linenumber") % 4 + 2).alias("level"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 48).alias("y"), color.alias("color"))
    return rows.groupBy("fid", "level", "x", "y").agg(F.min("color").alias("color"))


def placed(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    kps = o.select(F.col("o_orderkey").alias("kp_id"), (F.col("o_custkey") % 50).alias("fid"), (F.col("o_totalprice") - F.floor(F.col("o_totalprice") / 64) * 64).alias("x"), ((F.col("o_orderkey") % 48) + 0.5).alias("y"))
    return regions.keypoint_colors(kps, pixels(spark, sf_dir))


@query("a9_region_boxes", f"WITH {BOXES} SELECT * FROM boxes")
def a9(spark, sf_dir):
    return regions.boxes(pixels(spark, sf_dir))


@query("p10_pruned_regions", f"WITH {BOXES} SELECT fid, level, color FROM kept")
def p10(spark, sf_dir):
    return regions.pruned(regions.boxes(pixels(spark, sf_dir)), WIDTH, HEIGHT).select("fid", "level", "color")


@query("j8_keypoint_colors", f"WITH {SEGMENTS} SELECT * FROM placed")
def j8(spark, sf_dir):
    return placed(spark, sf_dir)


def _ids(spark, sf_dir):
    return regions.region_ids(placed(spark, sf_dir), regions.pruned(regions.boxes(pixels(spark, sf_dir)), WIDTH, HEIGHT))


@query("p11_u1_region_ids", f"WITH {SEGMENTS} SELECT fid, level, color, n, seg FROM ids")
def u1(spark, sf_dir):
    return _ids(spark, sf_dir).withColumn("seg", F.col("seg").cast("long"))


@query("s11_keypoint_segments", f"WITH {SEGMENTS} SELECT p.kp_id, p.fid, array_to_string(coalesce(list_sort(list(seg) FILTER (seg IS NOT NULL)), []), ',') AS segs FROM placed p LEFT JOIN ids USING (fid, level, color) GROUP BY p.kp_id, p.fid")
def s11(spark, sf_dir):
    return regions.keypoint_segments(placed(spark, sf_dir), _ids(spark, sf_dir)).withColumn("segs", F.array_join(F.col("segs").cast("array<string>"), ","))


WEIGHTED = f"""{KEYPOINTS}, counts AS (SELECT fid, word, count(*) AS n FROM keypoints GROUP BY ALL), sizes AS (SELECT fid, sum(n) AS nk FROM counts GROUP BY fid),
 idf AS (SELECT word, ln((SELECT sum(n) FROM counts)::DOUBLE / count(*)) AS idf FROM counts GROUP BY word),
 weights AS (SELECT fid, word, n, n::DOUBLE / nk * idf AS tfidf FROM counts JOIN sizes USING (fid) JOIN idf USING (word)),
 factors AS (SELECT fid, sqrt(sum(n * tfidf * tfidf)) AS factor FROM weights GROUP BY fid),
 kp AS (SELECT k.*, w.tfidf FROM keypoints k JOIN weights w USING (fid, word)),
 p AS (SELECT fid AS qfid, word, k AS pk, x AS px, y AS py, scl AS ps, ori AS po, tfidf AS pt, unnest(segs) AS qseg FROM kp WHERE fid % 100 = 0),
 q AS (SELECT fid, word, k AS qk, x AS qx, y AS qy, scl AS qs, ori AS qo, tfidf AS qt, unnest(segs) AS seg FROM kp),
 pairs AS (SELECT *, row_number() OVER (PARTITION BY qfid, fid, qseg, seg ORDER BY pk, qk) - 1 AS i FROM p JOIN q USING (word)),
 s AS (SELECT *, count(*) OVER g AS n, round(sum((ps + qs) / 2 * (qo - po)) OVER g / sum((ps + qs) / 2) OVER g, 9) AS dori FROM pairs WINDOW g AS (PARTITION BY qfid, fid, qseg, seg)),
 r AS (SELECT *, row_number() OVER (PARTITION BY qfid, fid, qseg, seg ORDER BY round(px * cos(dori) - py * sin(dori), 6), i) - 1 AS rx, row_number() OVER (PARTITION BY qfid, fid, qseg, seg ORDER BY qx, i) - 1 AS tx,
   row_number() OVER (PARTITION BY qfid, fid, qseg, seg ORDER BY round(px * sin(dori) + py * cos(dori), 6), i) - 1 AS ry, row_number() OVER (PARTITION BY qfid, fid, qseg, seg ORDER BY qy, i) - 1 AS ty FROM s WHERE n >= 2),
 lx AS (SELECT a.qfid, a.fid, a.qseg, a.seg, a.tx AS t, b.i AS label FROM r a JOIN r b ON (a.qfid, a.fid, a.qseg, a.seg, a.i) = (b.qfid, b.fid, b.qseg, b.seg, b.rx)),
 ly AS (SELECT a.qfid, a.fid, a.qseg, a.seg, a.ty AS t, b.i AS label FROM r a JOIN r b ON (a.qfid, a.fid, a.qseg, a.seg, a.i) = (b.qfid, b.fid, b.qseg, b.seg, b.ry)),
 mx AS (SELECT qfid, fid, qseg, seg, -sum(d) AS m FROM (SELECT *, CASE WHEN label < lag(label) OVER (PARTITION BY qfid, fid, qseg, seg ORDER BY t) THEN 1 ELSE 0 END AS d FROM lx) GROUP BY ALL),
 my AS (SELECT qfid, fid, qseg, seg, -sum(d) AS m FROM (SELECT *, CASE WHEN label < lag(label) OVER (PARTITION BY qfid, fid, qseg, seg ORDER BY t) THEN 1 ELSE 0 END AS d FROM ly) GROUP BY ALL),
 c AS (SELECT qfid, fid, qseg, seg, max(n) AS n, max(dori) AS dori, -sqrt(sum(pow((qo - po) / (4 * {regions.PI}::DOUBLE) - dori / (4 * {regions.PI}::DOUBLE), 2)) / max(n)) AS md, sum(pt * qt) AS tfidf FROM r GROUP BY ALL),
 g AS (SELECT c.*, least(mx.m, my.m)::BIGINT AS mg, greatest(0, n + 2.0 * least(mx.m, my.m)::DOUBLE + n * md) AS mall FROM c JOIN mx USING (qfid, fid, qseg, seg) JOIN my USING (qfid, fid, qseg, seg)),
 sc AS (SELECT i.qfid, i.fid, round(coalesce(x.s, 0) / factor, 6) AS sim FROM (SELECT DISTINCT qfid, fid FROM pairs) i LEFT JOIN (SELECT qfid, fid, sum(mall / n * tfidf) AS s FROM g GROUP BY ALL) x USING (qfid, fid) JOIN factors f ON f.fid = i.fid AND factor > 0)"""


def weighted(spark, sf_dir):
    """Keypoints with weights, and the norms of their images."""
    k = cut(keypoints(spark, sf_dir))
    w = bow.weights(bow.term_counts(k.select("fid", "word")))
    w = cut(w)
    return k.join(w.select("fid", "word", "tfidf"), ["fid", "word"]), bow.factors(w)


def pairs(spark, sf_dir):
    k, norms = weighted(spark, sf_dir)
    return regions.region_pairs(k.where("fid % 100 = 0"), k), norms


@query("j3_region_pairs", f"WITH {WEIGHTED} SELECT qfid, fid, qseg, seg, i, pk, qk FROM pairs")
def j3(spark, sf_dir):
    return pairs(spark, sf_dir)[0].select(*regions.GROUP, "i", F.col("p.k").alias("pk"), F.col("q.k").alias("qk"))


@query("g1_g4_region_consistency", f"WITH {WEIGHTED} SELECT qfid, fid, qseg, seg, n, round(dori, 6) + 0.0 AS dori, mg, round(md, 6) + 0.0 AS md, round(mall, 6) AS mall FROM g")
def consistency(spark, sf_dir):
    c = regions.consistency(pairs(spark, sf_dir)[0])
    return c.select(*regions.GROUP, "n", (F.round("dori", 6) + 0.0).alias("dori"), F.col("mg").cast("long").alias("mg"), (F.round("md", 6) + 0.0).alias("md"), F.round("mall", 6).alias("mall"))


@query("g5_region_ranking", f"WITH {WEIGHTED} SELECT *, row_number() OVER (PARTITION BY qfid ORDER BY sim DESC, fid DESC) AS rank FROM sc QUALIFY rank <= 50")
def ranking(spark, sf_dir):
    p, norms = pairs(spark, sf_dir)
    return bow.top(regions.group_scores(regions.consistency(p, small=True), norms), 50)
