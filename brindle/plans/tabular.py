"""Queries for samples, lookups and cluster metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import bow, cluster_metrics, joins, sampling
from brindle.plans.ranking import counted
from brindle.plans.registry import query
from brindle.plans.tables import DESCRIPTORS, IMAGES, INDEX, POSTINGS, descriptors, images, postings, read

HASH = "((({0} % 2147483648) + {1}) * 2654435761) % 4294967296"


@query("r1s_exact_sample", f"WITH {IMAGES} SELECT fid, path, row_number() OVER (ORDER BY {HASH.format('fid', 7)}, fid) <= 100 AS taken FROM images")
def r1s(spark, sf_dir):
    some, rest = sampling.exact(images(spark, sf_dir).select("fid", "path"), 100, "fid", 7)
    return some.withColumn("taken", F.lit(True)).unionByName(rest.withColumn("taken", F.lit(False)))


@query("r2s_stratified_sample", f"WITH {IMAGES} SELECT category, fid, path FROM images QUALIFY row_number() OVER (PARTITION BY category ORDER BY {HASH.format('fid', 3)}, fid) <= 10")
def r2s(spark, sf_dir):
    return sampling.stratified(images(spark, sf_dir), 10, "category", "fid", 3).select("category", "fid", "path")


@query("r3s_keypoints_per_image", f"WITH {DESCRIPTORS}, s AS (SELECT fid, kp_id FROM descriptors QUALIFY row_number() OVER (PARTITION BY fid ORDER BY {HASH.format('kp_id', 5)}, kp_id) <= 4) SELECT fid, kp_id, row_number() OVER (ORDER BY fid, kp_id) - 1 AS new_id FROM s")
def r3s(spark, sf_dir):
    some = sampling.stratified(descriptors(spark, sf_dir).select("fid", "kp_id"), 4, "fid", "kp_id", 5)
    return sampling.renumbered(some, "fid", "kp_id")


@query("r4s_random_keypoints", f"WITH {DESCRIPTORS} SELECT fid, kp_id FROM descriptors QUALIFY row_number() OVER (PARTITION BY fid ORDER BY {HASH.format('kp_id', 11)}, kp_id) <= 3")
def r4s(spark, sf_dir):
    return sampling.stratified(descriptors(spark, sf_dir).select("fid", "kp_id"), 3, "fid", "kp_id", 11)


@query("j6_ids_of_paths", "WITH i AS (SELECT source AS path, doc_id AS fid FROM documents), l AS (SELECT path, max(fid) AS fid FROM i GROUP BY path) SELECT o_orderkey AS line, p.path, coalesce(l.fid, 0) AS fid FROM (SELECT o_orderkey, 'src' || (o_custkey % 25) AS path FROM orders) p LEFT JOIN l USING (path)")
def j6(spark, sf_dir):
    listed = read(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("fid"), F.col("doc_id").alias("line"))
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), F.concat(F.lit("src"), (F.col("o_custkey") % 25).cast("string")).alias("path"))
    return joins.ids_of_paths(asked, listed)


@query("j10_merged_info", f"WITH {DESCRIPTORS} SELECT fid, count(*) AS n, round(sum(vec[1]), 6) AS first FROM descriptors GROUP BY fid")
def j10(spark, sf_dir):
    d = descriptors(spark, sf_dir)
    both = joins.merged(d.select("kp_id", "fid"), d.select("kp_id", "vec"))
    return both.groupBy("fid").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("vec", 1)), 6).alias("first"))


@query("s6_id_ranges", f"WITH {DESCRIPTORS} SELECT fid, min(kp_id) AS first_id, max(kp_id) AS last_id, count(*) AS n FROM descriptors GROUP BY fid")
def s6(spark, sf_dir):
    return joins.id_ranges(descriptors(spark, sf_dir))


ASSIGNED = "assigned AS (SELECT (vec_id * 7 + label) % 6 AS cluster, label FROM embeddings)"
TABLE = f"""{ASSIGNED}, cells AS (SELECT cluster, label, count(*) AS n FROM assigned GROUP BY ALL),
 m AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS nc, sum(n) OVER (PARTITION BY label) AS nl, sum(n) OVER () AS total FROM cells)"""


def assigned(spark, sf_dir):
    """Embeddings with a fixed clustering."""
    return read(spark, sf_dir, "embeddings").select(((F.col("vec_id") * 7 + F.col("label")) % 6).alias("cluster"), "label")


def table(spark, sf_dir):
    return cluster_metrics.confusion(assigned(spark, sf_dir))


@query("a18_confusion", f"WITH {TABLE} SELECT cluster, label, n FROM cells")
def a18(spark, sf_dir):
    return table(spark, sf_dir)


@query("a18_confusion_of_documents", "SELECT d.doc_id % 5 AS cluster, l.quality * 2 + l.toxic AS label, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def a18_documents(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id")
    return cluster_metrics.confusion(both.select((F.col("doc_id") % 5).alias("cluster"), (F.col("quality") * 2 + F.col("toxic")).alias("label")))


@query("a19_purity_entropy", f"WITH {TABLE} SELECT cluster, nc::BIGINT AS size, round(max(n / nc), 6) AS purity, round(-sum(n / nc * ln(n / nc)) / ln(10), 6) AS entropy FROM m GROUP BY cluster, nc")
def a19(spark, sf_dir):
    return cluster_metrics.purity_entropy(table(spark, sf_dir), 10).withColumns({"purity": F.round("purity", 6), "entropy": F.round("entropy", 6)})


@query("a19_averages", f"WITH {TABLE}, c AS (SELECT cluster, max(n / nc) AS purity, -sum(n / nc * ln(n / nc)) / ln(10) AS entropy FROM m GROUP BY cluster) SELECT round(sum(purity) / 6, 6) AS purity, round(sum(entropy) / 6, 6) AS entropy FROM c")
def a19_averages(spark, sf_dir):
    mean = cluster_metrics.averages(cluster_metrics.purity_entropy(table(spark, sf_dir), 10), 6)
    return mean.select(F.round("purity", 6).alias("purity"), F.round("entropy", 6).alias("entropy"))


@query(
    "a20_mutual_information",
    f"""WITH {TABLE}, x AS (SELECT sum(n / total * ln(n / total / (nc / total * nl / total))) AS mi FROM m),
     h AS (SELECT (SELECT -sum(p * ln(p)) FROM (SELECT max(nc / total) AS p FROM m GROUP BY cluster)) + (SELECT -sum(p * ln(p)) FROM (SELECT max(nl / total) AS p FROM m GROUP BY label)) AS hs)
    SELECT round(mi, 6) AS mi, round(mi / (hs / 2), 6) AS nmi FROM x, h""",
)
def a20(spark, sf_dir):
    return cluster_metrics.normalised_mutual_information(table(spark, sf_dir)).select(F.round("mi", 6).alias("mi"), F.round("nmi", 6).alias("nmi"))


@query("a21_f_measure", f"WITH {TABLE}, f AS (SELECT label, nl, total, max(2 * (n / nc) * (n / nl) / (n / nc + n / nl)) AS f FROM m GROUP BY ALL) SELECT round(sum(f * nl) / max(total), 6) AS f_measure FROM f")
def a21(spark, sf_dir):
    return cluster_metrics.f_measure(table(spark, sf_dir)).select(F.round("f_measure", 6).alias("f_measure"))


@query(
    "a22_micro_precision_recall",
    f"""WITH {TABLE}, named AS (SELECT cluster, label AS named FROM cells QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1),
     c AS (SELECT label, named, n FROM cells JOIN named USING (cluster)),
     p AS (SELECT l.label, (SELECT coalesce(sum(n), 0) FROM c WHERE c.label = l.label AND c.named = l.label) AS r, (SELECT coalesce(sum(n), 0) FROM c WHERE c.named = l.label) AS cl, (SELECT sum(n) FROM c WHERE c.label = l.label) AS p FROM (SELECT DISTINCT label FROM cells) l)
    SELECT label, round(CASE WHEN cl = 0 THEN 0 ELSE r / cl END, 6) AS precision, round(r / p, 6) AS recall FROM p
    UNION ALL SELECT NULL, round(sum(r) / sum(cl), 6), round(sum(r) / sum(p), 6) FROM p""",
)
def a22(spark, sf_dir):
    return cluster_metrics.micro_precision_recall(table(spark, sf_dir)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(
    "a23_matrix_information",
    f"WITH {INDEX}, c AS (SELECT word, tf, nk::DOUBLE / (SELECT sum(nk) FROM sizes) AS prior FROM weights), r AS (SELECT word, sum(prior * tf) AS row FROM c GROUP BY word) SELECT round(sum(prior * tf * log2(tf / row)), 6) AS bits FROM c JOIN r USING (word)",
)
def a23(spark, sf_dir):
    counts, _ = counted(spark, sf_dir)
    sizes = bow.image_sizes(counts)
    priors = sizes.join(F.broadcast(sizes.agg(F.sum("nk").alias("all")))).select(F.col("fid").alias("doc_id"), (F.col("nk") / F.col("all")).alias("prior"))
    cells = bow.frequencies(counts).select(F.col("fid").alias("doc_id"), "word", F.col("tf").alias("val"))
    return cluster_metrics.mutual_information(cells, priors).select(F.round("bits", 6).alias("bits"))


@query("a24_sparse_norms", f"WITH {INDEX} SELECT fid, round(sum(tf), 6) AS l1, round(sum(n * n)::BIGINT / max(nk * nk)::DOUBLE, 9) AS l2_squared, round(sum(tf * ln(tf)), 6) AS entropy FROM weights GROUP BY fid")
def a24(spark, sf_dir):
    w = bow.frequencies(bow.term_counts(postings(spark, sf_dir)))
    tf = F.col("tf")
    return w.groupBy("fid").agg(F.round(F.sum(tf), 6).alias("l1"), F.round(F.sum(F.col("n") * F.col("n")) / F.max(F.col("nk") * F.col("nk")), 9).alias("l2_squared"), F.round(F.sum(tf * F.log(tf)), 6).alias("entropy"))


@query("t6_best_keypoints", """WITH k AS (SELECT l_orderkey AS fid, l_extendedprice AS a, l_quantity AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS kp FROM lineitem),
     m AS (SELECT *, avg(1 / a) OVER w AS ma, avg(b) OVER w AS mb FROM k WINDOW w AS (PARTITION BY fid)),
     s AS (SELECT *, sqrt(sum((1 / a - ma) * (1 / a - ma)) OVER w) AS sa, sqrt(sum((b - mb) * (b - mb)) OVER w) AS sb FROM m WINDOW w AS (PARTITION BY fid)),
     v AS (SELECT fid, kp, round(0.5 * ((1 / a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END + 1) / 2 + 0.5 * ((b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END + 1) / 2, 6) AS score FROM s)
    SELECT fid, kp, score FROM v QUALIFY row_number() OVER (PARTITION BY fid ORDER BY score, kp) <= 3""")
def t6(spark, sf_dir):
    from brindle.operators.selection import best_keypoints

    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    k = li.select(F.col("l_orderkey").alias("fid"), F.col("l_extendedprice").alias("contr"), F.col("l_quantity").alias("rpc"), F.row_number().over(order).alias("kp"))
    return best_keypoints(k, 3, 0.5).select("fid", F.col("kp").cast("long").alias("kp"), "score")


@query("t7_by_scale", "SELECT fid, k, round(scl, 6) AS scl, row_number() OVER (PARTITION BY fid ORDER BY round(scl, 6) DESC, k) AS rank FROM (SELECT l_orderkey AS fid, l_discount * 100 + 1 AS scl, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS k FROM lineitem)")
def t7(spark, sf_dir):
    from brindle.plans.tables import keypoints

    k = keypoints(spark, sf_dir).select("fid", F.col("k").cast("long").alias("k"), F.round("scl", 6).alias("scl"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("fid").orderBy(F.col("scl").desc(), "k")).cast("long"))


@query("s16_wide_marks", f"WITH {POSTINGS}, {IMAGES}, n AS (SELECT fid, count(*) AS n FROM postings GROUP BY fid) SELECT category, count(*) FILTER (n >= 10) AS m10, count(*) FILTER (n >= 100) AS m100, count(*) FILTER (n >= 1000) AS m1000 FROM n JOIN images USING (fid) GROUP BY category")
def s16(spark, sf_dir):
    sizes = postings(spark, sf_dir).groupBy("fid").agg(F.count("*").alias("nk")).join(images(spark, sf_dir), "fid")
    marks = sizes.withColumn("mark", F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000)))).withColumn("over", F.when(F.col("nk") >= F.col("mark"), 1))
    wide = marks.groupBy("category").pivot("mark", [10, 100, 1000]).agg(F.count("over"))
    return wide.select("category", *[F.col(str(m)).alias(f"m{m}") for m in (10, 100, 1000)])
