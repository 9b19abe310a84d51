"""Queries for nearest neighbours, votes, matching and evaluation. Searches ask for every row whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import bow, evaluation, knn
from brindle.plans.ranking import counted, ranked, voting
from brindle.plans.registry import query
from brindle.plans.tables import DESCRIPTORS, IMAGES, INDEX, RANKED, descriptors, images
from brindle.sources.shared import cut

K = 60
KNN = f"""{DESCRIPTORS}, near AS (SELECT q.kp_id AS q_kp, q.fid AS qid, q.category AS qcat, d.kp_id, d.fid, d.category = q.category AS hit, round(sqrt(list_sum([(q.vec[i] - d.vec[i]) * (q.vec[i] - d.vec[i]) for i in range(1, len(q.vec) + 1)])), 6) AS dist
   FROM descriptors q CROSS JOIN descriptors d WHERE q.kp_id % 100 = 0),
 knn AS (SELECT *, row_number() OVER (PARTITION BY q_kp ORDER BY dist, kp_id) AS rank FROM near QUALIFY rank <= {K})"""


def neighbours(spark, sf_dir, limit=None):
    """kNN matches with the query's file (qid) and whether the categories agree (hit)."""
    d = descriptors(spark, sf_dir)
    found = knn.nearest(d.where("kp_id % 100 = 0"), d, K, limit)
    own = d.select(F.col("kp_id").alias("q_kp"), F.col("fid").alias("qid"), F.col("category").alias("own"))
    other = d.select("kp_id", F.col("category").alias("other"))
    return found.join(own, "q_kp").join(other, "kp_id").withColumn("hit", F.col("own") == F.col("other"))


@query("j4_t4_nearest_neighbours", f"WITH {KNN} SELECT q_kp, kp_id, fid, dist, rank FROM knn")
def nearest(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    return knn.nearest(d.where("kp_id % 100 = 0"), d, K).select("q_kp", "kp_id", "fid", "dist", F.col("rank").cast("long").alias("rank"))


LSH = {"width": 0.25, "tables": 20, "hashes": 2}


@query("j4_lsh_neighbours")
def lsh(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    return knn.nearest_lsh(d.where("kp_id % 100 = 0"), d, K, **LSH)


@query("j4_lsh_recall_and_share")
def lsh_recall(spark, sf_dir):
    """What the buckets are worth: the share of the true neighbours found, and the share of all descriptors looked at for it."""
    d = descriptors(spark, sf_dir)
    return spark.createDataFrame([knn.lsh_recall(d.where("kp_id % 100 = 0"), d, K, **LSH)], "recall double, share double")


PROBES = {"width": 0.35, "tables": 10, "hashes": 16, "probes": 60}


def sketches(spark, sf_dir):
    """Sketches of the documents' words, vectors that cluster."""
    counts, parts = counted(spark, sf_dir)
    return cut(knn.sketches(bow.weights(counts, parts).repartition(parts, "fid")))


@query("j4_probed_neighbours")
def probed(spark, sf_dir):
    """Multi-probe search of the documents' sketches; tested against brute force."""
    d = sketches(spark, sf_dir)
    return knn.nearest_probed(d.where("kp_id % 100 = 0"), d, K, **PROBES)


@query("j4_probed_recall_and_share")
def probed_recall(spark, sf_dir):
    """The share of the true neighbours among what the probes touch, and the share of all vectors touched."""
    d = sketches(spark, sf_dir)
    return spark.createDataFrame([knn.probed_recall(d.where("kp_id % 100 = 0"), d, K, **PROBES)], "recall double, share double")


@query("a17_touched_share")
def touched(spark, sf_dir):
    """Mean and deviation of the share of all vectors that a query's probes touch."""
    d = sketches(spark, sf_dir)
    return knn.probed_share(knn.probed_counts(d.where("kp_id % 100 = 0"), d, **PROBES), d.count())


@query("p5_distance_limit", f"WITH {KNN} SELECT q_kp, kp_id, dist FROM knn WHERE dist <= 1.3")
def p5(spark, sf_dir):
    return neighbours(spark, sf_dir, 1.3).select("q_kp", "kp_id", "dist")


@query("a5_t3_p6_match_votes", f"WITH {KNN}, v AS (SELECT qid, fid, count(*) AS n FROM knn GROUP BY ALL HAVING count(*) >= 2) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, fid ASC) AS rank FROM v QUALIFY rank <= 200")
def match_votes(spark, sf_dir):
    votes = knn.image_votes(neighbours(spark, sf_dir)).where("n >= 2")
    return bow.top(votes, 200, "n", larger_id_first=False, group="qid")


@query("a6_votes_once", f"WITH {KNN} SELECT qid, fid, count(DISTINCT q_kp) AS n FROM knn GROUP BY ALL")
def a6(spark, sf_dir):
    return knn.image_votes(neighbours(spark, sf_dir), once=True)


@query("a17_probed_share", f"WITH {KNN}, s AS (SELECT q_kp, count(*) / (SELECT count(*) FROM descriptors)::DOUBLE AS share FROM near WHERE dist <= 1.4 GROUP BY q_kp) SELECT round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS deviation FROM s")
def a17(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    n = d.count()
    shares = knn.probed_share(knn.seen_within(d.where("kp_id % 100 = 0"), d, 1.4), n)
    return shares.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(
    "j7_ratio_matches",
    f"""WITH {DESCRIPTORS}, d AS (SELECT a.fid AS pair, a.kp_id AS left_kp, b.kp_id AS right_kp, round(sqrt(list_sum([(a.vec[i] - b.vec[i]) * (a.vec[i] - b.vec[i]) for i in range(1, len(a.vec) + 1)])), 6) AS d
      FROM descriptors a JOIN descriptors b ON b.fid = a.fid + 1),
     s AS (SELECT pair, left_kp, d, max(right_kp) AS right_kp FROM d GROUP BY ALL),
     t AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY pair, left_kp ORDER BY d)),
     r AS (SELECT pair, left_kp, right_kp, d AS d1, CASE WHEN d2 = 0 THEN 0.0 ELSE round(d / d2, 6) END AS ratio FROM t WHERE k = 1)
    SELECT * FROM r WHERE ratio <= 0.9 OR d1 <= 1.1""",
)
def j7(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    return knn.ratio_matches(d.withColumn("pair", F.col("fid")), d.withColumn("pair", F.col("fid") - 1), 0.9, 1.1)


@query("a16_precision_recall", f"""WITH {KNN}, b AS (SELECT unnest(range(0, least(CAST(floor(dist / 0.2) AS BIGINT), 9) + 1)) AS bucket, qid, fid, hit FROM knn),
     c AS (SELECT bucket, qid, fid, count(*) AS n, bool_and(hit) AS hit FROM b GROUP BY bucket, qid, fid),
     t AS (SELECT *, unnest(range(0, least(n - 2, 9) + 1)) AS threshold FROM c WHERE n > 1)
    SELECT bucket::INT AS bucket, threshold::INT AS threshold, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS wrong, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS precision, round(count(*) FILTER (hit) / 1000.0::DOUBLE, 6) AS recall FROM t GROUP BY ALL""")
def a16(spark, sf_dir):
    grid = evaluation.precision_recall(_by_image(spark, sf_dir), width=0.2)
    return grid.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("a16_precision_recall_by_radius", f"""WITH {KNN}, b AS (SELECT unnest(range(CAST(floor(dist / 0.2) AS BIGINT), 10)) AS bucket, qid, fid, hit FROM knn),
     c AS (SELECT bucket, qid, fid, count(*) AS n, bool_and(hit) AS hit FROM b GROUP BY bucket, qid, fid),
     t AS (SELECT *, unnest(range(0, least(n - 2, 9) + 1)) AS threshold FROM c WHERE n > 1)
    SELECT bucket::INT AS bucket, threshold::INT AS threshold, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS wrong, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS precision, round(count(*) FILTER (hit) / 1000.0::DOUBLE, 6) AS recall FROM t GROUP BY ALL""")
def a16_radius(spark, sf_dir):
    grid = evaluation.precision_recall(_by_image(spark, sf_dir), width=0.2, mode="radius")
    return grid.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def _by_image(spark, sf_dir):
    """kNN matches where an image agrees with the query if all its matched keypoints do."""
    found = neighbours(spark, sf_dir)
    return found.select("qid", "fid", "dist", "hit")


JUDGED = f"""{RANKED}, {IMAGES}, judged AS (SELECT r.*, q.category, q.category = m.category AS hit FROM ranked r JOIN images q ON q.fid = r.qfid JOIN images m ON m.fid = r.fid)"""
SCORES = f"""{JUDGED}, cuts AS (SELECT unnest([10, 20, 30, 40, 50]) AS k),
 scores AS (SELECT qfid, category, k, count(*) FILTER (hit AND rank <= k) AS correct, count(*) FILTER (NOT hit AND rank <= k) AS wrong,
   coalesce(sum(2.0::DOUBLE - 0.5 * least((rank - 1) // (k // 4), 3)) FILTER (hit AND rank <= k), 0) / (5.0::DOUBLE * (k // 4) + 0.5 * (k - 4 * (k // 4))) AS score FROM judged CROSS JOIN cuts GROUP BY qfid, category, k)"""


def judged(spark, sf_dir, k=50):
    """The best ``k`` of each query; ranks don't depend on it."""
    return evaluation.judged(ranked(spark, sf_dir, k), images(spark, sf_dir))


@query("j9_judged_results", f"WITH {JUDGED} SELECT qfid, rank, fid, category, hit FROM judged")
def j9(spark, sf_dir):
    return judged(spark, sf_dir).select("qfid", "rank", "fid", "category", "hit")


@query("a12_a13_tier_scores", f"WITH {SCORES} SELECT qfid, category, k, correct, wrong, round(score, 6) AS score FROM scores")
def a13(spark, sf_dir):
    return evaluation.query_scores(judged(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("a14_category_scores", f"WITH {SCORES} SELECT category, k, sum(correct)::BIGINT AS correct, sum(wrong)::BIGINT AS wrong, round(avg(score), 6) AS score FROM scores GROUP BY ALL")
def a14(spark, sf_dir):
    return evaluation.category_scores(evaluation.query_scores(judged(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(
    "a14_t9_best_queries",
    f"""WITH {SCORES}, b AS (SELECT qfid, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, qfid) AS place FROM scores WHERE k = 20 QUALIFY place <= 10)
    SELECT category, k, sum(correct)::BIGINT AS correct, sum(wrong)::BIGINT AS wrong, round(avg(score), 6) AS score FROM scores WHERE qfid IN (SELECT qfid FROM b) GROUP BY category, k""",
)
def best(spark, sf_dir):
    scores = evaluation.query_scores(judged(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return evaluation.category_scores(scores, best=10).withColumn("score", F.round("score", 6))


@query(
    "a15_simple_scores",
    f"""WITH {JUDGED}, s AS (SELECT qfid, category, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS wrong, coalesce(sum(2.0::DOUBLE - 0.5 * least((rank - 1) // 5, 3)) FILTER (hit), 0) / 25 AS score FROM judged WHERE rank <= 20 GROUP BY ALL)
    SELECT category, round(sum(score) * 20 / sum(correct + wrong), 6) AS score FROM s GROUP BY category""",
)
def a15(spark, sf_dir):
    return evaluation.simple_category_scores(evaluation.simple_scores(judged(spark, sf_dir, 20))).withColumn("score", F.round("score", 6))


@query(
    "a12_counts_at_marks",
    f"""WITH {INDEX}, {IMAGES}, v AS (SELECT q.fid AS qid, m.fid, sum(q.n * m.n)::BIGINT AS n FROM counts q JOIN counts m USING (word) WHERE q.fid % 100 = 0 GROUP BY ALL),
     h AS (SELECT v.qid, n, a.category = b.category AS hit FROM v JOIN images a ON a.fid = v.qid JOIN images b ON b.fid = v.fid)
    SELECT qid, mark, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS wrong FROM h JOIN (SELECT unnest({list(evaluation.MARKS)}) AS mark) ON n >= mark GROUP BY ALL""",
)
def a12(spark, sf_dir):
    asked, counts, parts = voting(spark, sf_dir)
    own = images(spark, sf_dir).groupBy("fid", "category").agg(F.count("*").alias("times"))
    return evaluation.marked_votes(asked, counts, own, parts=parts)
