"""Queries over the bag-of-words index. Searches take as queries every image whose id is divisible by 100."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import blocks, bow, scores
from brindle.plans.registry import query
from brindle.plans.tables import DESCRIPTORS, IMAGES, INDEX, POSTINGS, RANKED, descriptors, images, postings, text_parts
from brindle.sources.shared import bucketed, stored

ASKED = "fid % 100 = 0"


def counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(fid, word, n) as a table by image, a few bytes a row, read by every search; and the number of its parts."""
    parts = text_parts(spark, sf_dir)
    return bucketed(bow.term_counts(postings(spark, sf_dir, parts)), "counts", parts, "fid"), parts


@dataclass
class Weighed:
    """Queries (qfid, word, w) and images (fid, word, n, nk, factor): the sums of w * n * n / nk over shared words, divided by factor, are their similarities."""

    asked: DataFrame
    images: DataFrame
    parts: int
    value: Column = field(default_factory=lambda: F.col("n").cast("double") * F.col("n") / F.col("nk"))
    factor: Column = field(default_factory=lambda: F.col("factor"))


def weighed(spark: SparkSession, sf_dir: str, augmented: bool = False) -> Weighed:
    """The asked images and all images by TF-IDF; the image's idf is a part of w, so that no image's row is joined by word."""
    counts, parts = counted(spark, sf_dir)
    idf = stored(bow.inverse_frequency(counts), "idf")
    norms = stored(bow.norms(counts, idf, parts), "norms")
    known = counts.where(ASKED).join(norms.where(ASKED), "fid").join(idf, "word")
    tf = F.col("n").cast("double") / F.col("nk")
    w = F.col("n") * ((0.5 * tf + 0.5 if augmented else tf) * F.col("idf")) * F.col("idf")
    asked = stored(known.select(F.col("fid").alias("qfid"), "word", w.alias("w")), "asked")
    return Weighed(asked, counts.join(norms.where("factor > 0"), "fid"), parts)


def voting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Queries (qfid, word, w) and images (fid, word, n), both by counts, and the parts of the images."""
    counts, parts = counted(spark, sf_dir)
    return counts.where(ASKED).select(F.col("fid").alias("qfid"), "word", F.col("n").alias("w")), counts, parts


def ranked(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """(qfid, fid, sim, rank) of the flagship query."""
    x = weighed(spark, sf_dir)
    return scores.top(x.asked, x.images, k, x.value, x.factor, parts=x.parts)


@query("flagship_bow_ranking", f"WITH {RANKED} SELECT qfid, fid, sim, rank FROM ranked")
def flagship(spark, sf_dir):
    return ranked(spark, sf_dir).select("qfid", "fid", "sim", "rank")


@query("a1_keypoints_per_image", f"WITH {POSTINGS} SELECT fid, count(*) AS nk FROM postings GROUP BY fid")
def a1(spark, sf_dir):
    return postings(spark, sf_dir).groupBy("fid").agg(F.count("*").alias("nk"))


@query("a2_term_frequency", f"WITH {INDEX} SELECT fid, word, n, round(tf, 9) AS tf FROM weights")
def a2(spark, sf_dir):
    return bow.frequencies(bow.term_counts(postings(spark, sf_dir))).select("fid", "word", "n", F.round("tf", 9).alias("tf"))


@query("a3_inverse_frequency", f"WITH {INDEX} SELECT word, ni, round(idf, 6) AS idf FROM idf")
def a3(spark, sf_dir):
    return bow.inverse_frequency(bow.term_counts(postings(spark, sf_dir))).select("word", "ni", F.round("idf", 6).alias("idf"))


@query("a4_image_norms", f"WITH {INDEX} SELECT fid, round(factor, 6) AS factor FROM factors")
def a4(spark, sf_dir):
    counts, parts = counted(spark, sf_dir)
    return bow.norms(counts, bow.inverse_frequency(counts), parts).select("fid", F.round("factor", 6).alias("factor"))


@query("s9_tfidf_postings", f"WITH {INDEX} SELECT fid, word, round(tfidf, 9) AS tfidf FROM weights")
def s9(spark, sf_dir):
    return bow.weights(*counted(spark, sf_dir)).select("fid", "word", F.round("tfidf", 9).alias("tfidf"))


@query(
    "a5_t2_votes",
    f"""WITH {INDEX}, v AS (SELECT q.fid AS qfid, m.fid, sum(q.n * m.n)::BIGINT AS n FROM counts q JOIN counts m USING (word) WHERE q.fid % 100 = 0 GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY qfid ORDER BY n DESC, fid DESC) AS rank FROM v QUALIFY rank <= 50""",
)
def a5(spark, sf_dir):
    asked, found, parts = voting(spark, sf_dir)
    return scores.top(asked, found, 50, F.col("n"), parts=parts)


@query(
    "a7_similarities",
    f"""WITH {INDEX} SELECT q.fid AS qfid, m.fid, round(sum(q.n * q.tfidf * (m.n * m.tfidf)) / max(f.factor), 6) AS sim
    FROM weights q JOIN weights m USING (word) JOIN factors f ON f.fid = m.fid AND f.factor > 0 WHERE q.fid % 100 = 0 GROUP BY q.fid, m.fid""",
)
def a7(spark, sf_dir):
    x = weighed(spark, sf_dir)
    return scores.pairs(x.asked, x.images, x.value, x.factor, parts=x.parts).withColumnRenamed("score", "sim")


@query(
    "a7_augmented_ranking",
    f"""WITH {INDEX}, q AS (SELECT fid, word, n, (0.5 * n / nk + 0.5) * idf AS tfidf FROM weights WHERE fid % 100 = 0),
    s AS (SELECT q.fid AS qfid, m.fid, round(sum(q.n * q.tfidf * (m.n * m.tfidf)) / max(f.factor), 6) AS sim
      FROM q JOIN weights m USING (word) JOIN factors f ON f.fid = m.fid AND f.factor > 0 GROUP BY q.fid, m.fid)
    SELECT *, row_number() OVER (PARTITION BY qfid ORDER BY sim DESC, fid DESC) AS rank FROM s QUALIFY rank <= 20""",
)
def augmented(spark, sf_dir):
    x = weighed(spark, sf_dir, augmented=True)
    return scores.top(x.asked, x.images, 20, x.value, x.factor, parts=x.parts)


def _indexed(spark: SparkSession, sf_dir: str) -> blocks.Index:
    counts, parts = counted(spark, sf_dir)
    return blocks.build(counts, parts=parts)


@query("t1_bounded_ranking", f"WITH {RANKED} SELECT qfid, fid, sim, rank FROM ranked")
def t1_bounded(spark, sf_dir):
    """The flagship's rows from an index in blocks."""
    found = _indexed(spark, sf_dir)
    return blocks.top(found.rows.where(ASKED), found, 50)


@query("t1_rows_matched")
def t1_work(spark, sf_dir):
    """Postings of each query's words and the rows that t1_bounded_ranking matched instead; tested against numpy."""
    found = _indexed(spark, sf_dir)
    return blocks.work(found.rows.where(ASKED), found, 50)


@query("j1_postings_with_paths", f"WITH {POSTINGS}, {IMAGES} SELECT path, count(*) AS n, count(DISTINCT word) AS n_words FROM postings JOIN images USING (fid) GROUP BY path")
def j1(spark, sf_dir):
    counts = bow.term_counts(postings(spark, sf_dir)).groupBy("fid").agg(F.sum("n").alias("n"), F.count("*").alias("n_words"))
    return counts.join(images(spark, sf_dir), "fid").select("path", "n", "n_words")


@query("j2_word_matches", f"WITH {INDEX} SELECT q.fid AS qfid, m.fid, count(*) AS n_words FROM counts q JOIN counts m USING (word) WHERE q.fid % 100 = 0 GROUP BY ALL")
def j2(spark, sf_dir):
    asked, found, parts = voting(spark, sf_dir)
    return scores.pairs(asked.withColumn("w", F.lit(1)), found, F.lit(1), parts=parts).select("qfid", "fid", F.col("score").cast("long").alias("n_words"))


@query("p8_orphan_postings", f"WITH {DESCRIPTORS}, {IMAGES} SELECT p.kp_id, p.word, fid, path FROM (SELECT kp_id * 2 AS kp_id, category AS word FROM descriptors) p JOIN descriptors d USING (kp_id) JOIN images USING (fid)")
def p8(spark, sf_dir):
    """Postings of every second id: those beyond the known keypoints drop out."""
    d = descriptors(spark, sf_dir)
    lists = d.select((F.col("kp_id") * 2).alias("kp_id"), F.col("category").alias("word"))
    return bow.named(lists, d.select("kp_id", "fid"), images(spark, sf_dir).select("fid", "path")).select("kp_id", "word", "fid", "path")
