"""Queries that write a table in an exchange format and read it back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from brindle.functions.vectors import rounded
from brindle.operators import bow
from brindle.plans.ranking import counted, ranked
from brindle.plans.registry import query
from brindle.plans.tables import DESCRIPTORS, IMAGES, INDEX, RANKED, descriptors, images, read
from brindle.sources import records, text
from brindle.sources.shared import cut, scratch


@query("s3_s4_vector_file", f"WITH {DESCRIPTORS} SELECT row_number() OVER (ORDER BY kp_id) - 1 AS kp_id, [round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) for x in vec] AS vec FROM descriptors")
def vector_file(spark, sf_dir):
    folder = scratch(spark, "vectors")
    records.write(descriptors(spark, sf_dir), folder)
    return records.read(spark, folder, rows=100).select("kp_id", F.transform("vec", lambda x: rounded(x.cast("double"))).alias("vec"))


@query("s5_feature_file", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS kp_id, vec_id // 10 AS fid, label::INT AS sid, vec_id % 640 AS x, vec_id % 480 AS y, CAST(2 AS DOUBLE) AS scl, CAST(0 AS DOUBLE) AS ori, CAST(0.5 AS DOUBLE) AS contr, CAST(1 AS DOUBLE) AS rpc, round(list_sum([CAST(x AS DOUBLE) for x in embedding]) * 2, 5) AS total FROM embeddings")
def feature_file(spark, sf_dir):
    folder = scratch(spark, "features")
    d = descriptors(spark, sf_dir)
    rows = d.select("kp_id", "fid", F.col("category").cast("int").alias("sid"), (F.col("kp_id") % 640).cast("double").alias("x"), (F.col("kp_id") % 480).cast("double").alias("y"), F.lit(2.0).alias("scl"), F.lit(0.0).alias("ori"), F.lit(0.5).alias("contr"), F.lit(1.0).alias("rpc"), F.concat("vec", "vec").alias("vec"))
    records.write(rows, folder, "features")
    got = records.read(spark, folder, "features", rows=64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.select("kp_id", "fid", "sid", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "scl", "ori", "contr", "rpc", F.round(total, 5).alias("total"))


@query("s1_image_list", f"WITH {IMAGES} SELECT fid::INT AS fid, path FROM images")
def image_list(spark, sf_dir):
    path = scratch(spark, "images")
    text.write_lines(images(spark, sf_dir).select("fid", "path"), path)
    return text.image_list(spark, path)


@query("s2_keypoint_info", "SELECT l_orderkey AS kp_id, CAST(l_partkey AS INTEGER) AS fid, l_quantity AS x, l_extendedprice AS y, l_discount AS scl, l_tax AS ori FROM lineitem")
def keypoint_info(spark, sf_dir):
    path = scratch(spark, "info")
    text.write_lines(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"), path)
    return text.keypoint_info(spark, path)


@query("s12_result_detail", f"WITH {RANKED} SELECT qfid, rank::INT AS rank, fid, sim FROM ranked")
def result_detail(spark, sf_dir):
    path = scratch(spark, "detail")
    text.write_result_detail(ranked(spark, sf_dir), path)
    return text.result_detail(spark, path).select("qfid", F.col("rank").cast("int").alias("rank"), "fid", "sim")


@query("s13_sparse_matrix", f"WITH {INDEX}, w AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM counts)) SELECT fid AS doc_id, word_id, n::DOUBLE AS val FROM counts JOIN w USING (word)")
def sparse(spark, sf_dir):
    """The matrix of all words by documents, written in ordered parts."""
    counts, parts = counted(spark, sf_dir)
    words = cut(text.numbered(counts.groupBy("word").agg(F.count("*").alias("ni")), "word", "word_id"))
    cells = bow.by_word(counts, words, parts).select(F.col("fid").alias("doc_id"), "word_id", F.col("n").alias("val"))
    prefix = scratch(spark, "matrix")
    text.write_sparse_matrix(cells, words.count(), prefix)
    return text.sparse_matrix(spark, prefix)


def lines(*columns):
    """Lines of a positional file: the columns side by side."""
    return F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("line")


@query("s13_dense_matrix", f"WITH {DESCRIPTORS} SELECT row_number() OVER (ORDER BY kp_id) - 1 AS doc_id, [round(x, 6) for x in vec] AS vec FROM descriptors")
def dense(spark, sf_dir):
    """A matrix of the descriptors in ordered parts, read back by rows."""
    prefix = scratch(spark, "dense")
    text.write_dense_matrix(descriptors(spark, sf_dir), prefix, "kp_id")
    return text.dense_rows(spark, prefix).select("doc_id", F.transform("vec", lambda x: rounded(x)).alias("vec"))


@query("s13_labels", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS doc_id, label::DOUBLE AS label FROM embeddings")
def labels(spark, sf_dir):
    """A label file (seedings and priors have the same form)."""
    e, path = read(spark, sf_dir, "embeddings"), scratch(spark, "labels")
    head = e.agg(F.count("*").alias("n")).select(F.lit(0).alias("k"), F.lit(None).cast("long").alias("vec_id"), lines("n", F.lit("1")))
    text.write_positional(head.unionByName(e.select(F.lit(1).alias("k"), "vec_id", lines("label"))), path, "k", "vec_id")
    return text.value_column(spark, path)


@query("s10_level_file", f"""WITH {DESCRIPTORS}, sizes AS (SELECT category, count(*) AS n FROM descriptors GROUP BY category)
    SELECT 'edge' AS kind, category % 3 AS a, count(*) AS b FROM sizes GROUP BY ALL UNION ALL SELECT 'size', category, n FROM sizes
    UNION ALL SELECT 'point', row_number() OVER (ORDER BY kp_id) - 1, category FROM descriptors""")
def level_file(spark, sf_dir):
    """A level of a hierarchy: categories under three parents, each descriptor in its category."""
    d, path = descriptors(spark, sf_dir), scratch(spark, "level")
    sizes = d.groupBy("category").agg(F.count("*").alias("n"))
    edges = sizes.groupBy((F.col("category") % 3).alias("parent")).agg(F.count("*").alias("n"))
    part = lambda df, k, at, line: df.select(F.lit(k).alias("k"), at.cast("long").alias("at"), line)
    counted = lambda df, k: part(df.agg(F.count("*").alias("n")), k, F.lit(0), lines("n"))
    rows = [counted(edges, 0), part(edges, 1, F.col("parent"), lines("parent", "n")), counted(sizes, 2), part(sizes, 3, F.col("category"), lines("category", "n")), part(d, 4, F.col("kp_id"), lines("category"))]
    text.write_positional(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4]), path, "k", "at")
    return text.read_level_file(spark, path)


@query("s7_s8_words_file", f"""WITH {DESCRIPTORS}, m AS (SELECT category, i, avg(vec[i]) AS x FROM descriptors, unnest(range(1, 65)) AS r(i) GROUP BY ALL), c AS (SELECT category, list(round(x, 6) ORDER BY i) AS center FROM m GROUP BY category),
     n AS (SELECT category, list(kp_id ORDER BY kp_id) AS sons FROM descriptors GROUP BY category)
    SELECT category::BIGINT AS node_id, true AS is_leaf, len(sons) AS npoints, sons, center FROM n JOIN c USING (category)""")
def words_file(spark, sf_dir):
    """A tree of one level: the categories as words, with their descriptors and centers."""
    d, path = descriptors(spark, sf_dir), scratch(spark, "words")
    means = d.select("category", F.posexplode("vec").alias("i", "x")).groupBy("category", "i").agg(F.avg("x").alias("x"))
    centers = means.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("i", F.format_string("%.6f", "x").alias("x")))).alias("c"))
    leaves = d.groupBy("category").agg(F.sort_array(F.collect_list("kp_id")).alias("sons")).join(centers, "category")
    n = F.size("sons").cast("string")
    body = leaves.select(F.lit(1).alias("k"), F.col("category").cast("long").alias("at"), lines("category", n, n, F.array_join(F.col("sons").cast("array<string>"), " "), F.array_join("c.x", " ")))
    top = leaves.agg(F.coalesce(F.sum(F.size("sons")), F.lit(0)).alias("points"), F.count("*").alias("nodes"), F.coalesce(F.max(F.size("c")), F.lit(0)).alias("dim"))
    text.write_positional(top.select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("at"), lines("points", "nodes", "nodes", "dim")).unionByName(body), path, "k", "at")
    got = text.read_words_file(spark, path)
    return got.select("node_id", "is_leaf", "npoints", "sons", F.transform("center", lambda x: F.round(x, 6)).alias("center"))


def _feature_files(spark, sf_dir, kind):
    """A feature file for each image, read back."""
    e, path = descriptors(spark, sf_dir), scratch(spark, kind)
    rows = e.select("fid", "kp_id", (F.col("kp_id") % 640).alias("x"), (F.col("kp_id") % 480).alias("y"), F.transform("vec", lambda x: rounded(x)).alias("vec") if kind == "oxford" else "vec")

    def run(f):
        f = f.sort_values("kp_id")
        made = [(r.x, r.y, 2.5, 0.25, 1.5, 0.5, 1.0, [int(abs(v) * 255) for v in r.vec] if kind == "lowe" else list(r.vec)) for r in f.itertuples()]
        return pd.DataFrame({"fid": [f["fid"].iloc[0]], "value": [text.format_features(made, kind)]})

    rows.groupBy("fid").applyInPandas(run, "fid long, value string").write.partitionBy("fid").text(path)
    found = text.read_features(spark, path, kind)
    return found.select(F.col("fid").cast("long").alias("fid"), "x", "y", "scl", "ori", "a", "b", "c", F.transform("vec", lambda x: rounded(x)).alias("vec"))


@query("s14_lowe_features", f"WITH {DESCRIPTORS} SELECT fid, (kp_id % 640)::DOUBLE AS x, (kp_id % 480)::DOUBLE AS y, 2.5::DOUBLE AS scl, 0.25::DOUBLE AS ori, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, [floor(abs(v) * 255)::DOUBLE for v in vec] AS vec FROM descriptors")
def lowe(spark, sf_dir):
    return _feature_files(spark, sf_dir, "lowe")


@query("s14_oxford_features", f"WITH {DESCRIPTORS} SELECT fid, (kp_id % 640)::DOUBLE AS x, (kp_id % 480)::DOUBLE AS y, 0::DOUBLE AS scl, 0::DOUBLE AS ori, 1.5::DOUBLE AS a, 0.5::DOUBLE AS b, 1::DOUBLE AS c, [round(v, 6) for v in vec] AS vec FROM descriptors")
def oxford(spark, sf_dir):
    return _feature_files(spark, sf_dir, "oxford")
