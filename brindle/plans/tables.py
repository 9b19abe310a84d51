"""The engine's tables as views over the driver's parquet tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text of which one task counts the words.
PART_BYTES = 8 << 20


def text_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts of about ``PART_BYTES`` that the texts make: their words take ten times the memory, whatever a shuffle of them is read as."""
    size = read(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def postings(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(fid, word): a row for each lower-case latin word of each document, in ``parts`` parts by fid.

    The texts are shuffled by document, which is less than their words would be; counts by (fid, word) then stay where they are.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts or text_parts(spark, sf_dir), "doc_id")
    return docs.select(F.col("doc_id").alias("fid"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, path, category): one image for each document, in the folder of its source."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("fid"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), F.col("source").alias("category"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kp_id, fid, category, vec): embeddings as descriptors, ten of an image."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("kp_id"), F.expr("vec_id div 10").alias("fid"), F.col("label").alias("category"), F.col("embedding").cast("array<double>").alias("vec"))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, k, word, x, y, scl, ori, segs): order lines as keypoints with a place, numbered within their order."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.withColumn("k", F.row_number().over(order) - 1).select(
        F.col("l_orderkey").alias("fid"), "k", F.col("l_partkey").alias("word"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        (F.col("l_discount") * 100 + 1).alias("scl"), (F.col("l_tax") * 10).alias("ori"),
        F.array((F.col("l_linenumber") % 2).cast("int"), (F.col("l_linenumber") % 3 + 2).cast("int")).alias("segs"),
    )


POSTINGS = "postings AS (SELECT doc_id AS fid, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"
IMAGES = "images AS (SELECT doc_id AS fid, '/' || source || '/' || doc_id || '.jpg' AS path, source AS category FROM documents)"
DESCRIPTORS = "descriptors AS (SELECT vec_id AS kp_id, vec_id // 10 AS fid, label AS category, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
KEYPOINTS = """keypoints AS (SELECT l_orderkey AS fid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS k,
  l_partkey AS word, l_quantity AS x, l_extendedprice AS y, l_discount * 100 + 1 AS scl, l_tax * 10 AS ori, [l_linenumber % 2, l_linenumber % 3 + 2] AS segs FROM lineitem)"""
#: (fid, word, n), weights and norms, as brindle.operators.bow computes them.
INDEX = f"""{POSTINGS},
 counts AS (SELECT fid, word, count(*) AS n FROM postings GROUP BY fid, word),
 sizes AS (SELECT fid, sum(n)::BIGINT AS nk FROM counts GROUP BY fid),
 idf AS (SELECT word, count(*) AS ni, ln((SELECT sum(n) FROM counts)::DOUBLE / count(*)) AS idf FROM counts GROUP BY word),
 weights AS (SELECT fid, word, n, nk, n::DOUBLE / nk AS tf, idf, n::DOUBLE / nk * idf AS tfidf FROM counts JOIN sizes USING (fid) JOIN idf USING (word)),
 factors AS (SELECT fid, sqrt(sum(n * tfidf * tfidf)) AS factor FROM weights GROUP BY fid)"""
RANKED = f"""{INDEX},
 sims AS (SELECT q.fid AS qfid, m.fid, round(sum(q.n * q.tfidf * (m.n * m.tfidf)) / max(f.factor), 6) AS sim
   FROM weights q JOIN weights m USING (word) JOIN factors f ON f.fid = m.fid AND f.factor > 0 WHERE q.fid % 100 = 0 GROUP BY q.fid, m.fid),
 ranked AS (SELECT qfid, fid, sim, row_number() OVER (PARTITION BY qfid ORDER BY sim DESC, fid DESC) AS rank FROM sims QUALIFY rank <= 50)"""
