"""Bag-of-words index and ranking: term counts, TF-IDF weights, image norms, similarity and votes.

A posting is one occurrence (fid, word). Weights are constant within (fid, word), so everything is summed to
(fid, word, n) before the word join: the join is over distinct words of an image, not over pairs of occurrences.

The index lies by image. A query set of up to ``QUERY_ROWS`` rows is broadcast to it, so that an image's matches are summed where its rows are
and no pair of images is shuffled; a larger one is joined by word, the images of frequent words being dealt into parts. Every query
meets every image that shares a word with it: the work is the number of such pairs, whichever way it is shared out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.joins import spread_join
from brindle.sources.shared import stored

#: Rows of a query set that is broadcast, and bytes of its words.
QUERY_ROWS, QUERY_BYTES = 1_000_000, 64 << 20
#: Words of over this share of all counts, fewer than it by that bound, are broadcast to the counts.
SHARE = 1 << 17


def term_counts(postings: DataFrame) -> DataFrame:
    """(fid, word, n)"""
    return postings.groupBy("fid", "word").agg(F.count("*").alias("n"))


def image_sizes(counts: DataFrame) -> DataFrame:
    """(fid, nk): keypoints of each image."""
    return counts.groupBy("fid").agg(F.sum("n").alias("nk"))


def inverse_frequency(counts: DataFrame) -> DataFrame:
    """(word, ni, idf): idf = ln(N / ni), where N counts keypoints and ni images. ``counts`` is read once; a row a word is written."""
    per_word = stored(counts.groupBy("word").agg(F.count("*").alias("ni"), F.sum("n").alias("nw")), "words")
    total = per_word.agg(F.sum("nw").alias("total"))
    # ``total`` is one row.
    return per_word.join(F.broadcast(total)).select("word", "ni", F.log(F.col("total").cast("double") / F.col("ni")).alias("idf"))


def frequencies(counts: DataFrame) -> DataFrame:
    """(fid, word, n, nk, tf), by image; images without id are left out. Counts that lie by image stay where they are."""
    own = counts.where("fid IS NOT NULL").withColumn("nk", F.sum("n").over(Window.partitionBy("fid")))
    return own.select("fid", "word", "n", "nk", (F.col("n").cast("double") / F.col("nk")).alias("tf"))


def by_word(counts: DataFrame, words: DataFrame, parts: int = 0) -> DataFrame:
    """``counts`` joined with ``words``, a row for each word with its number ``ni`` of counts: they stay where they are but for the words that few images have, which are shuffled into ``parts`` parts."""
    total = words.agg(F.sum("ni")).first()[0] or 0
    return spread_join(counts, words, ["word"], "ni", total, SHARE, parts)


def weights(counts: DataFrame, parts: int = 0) -> DataFrame:
    """(fid, word, n, nk, tf, idf, tfidf). ``counts`` is read three times, best from a table by image of ``parts`` parts."""
    known = by_word(frequencies(counts), inverse_frequency(counts), parts)
    return known.withColumn("tfidf", F.col("tf") * F.col("idf")).select("fid", "word", "n", "nk", "tf", "idf", "tfidf")


def augmented_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(fid, word, n, tfidf) of query images outside the index: tf = 0.5 n / nk + 0.5; words the index lacks are left out."""
    joined = counts.join(image_sizes(counts), "fid").join(idf, "word")
    return joined.select("fid", "word", "n", ((0.5 * F.col("n") / F.col("nk") + 0.5) * F.col("idf")).alias("tfidf"))


def factors(weighted: DataFrame) -> DataFrame:
    """(fid, factor): the norm over all occurrences."""
    return weighted.groupBy("fid").agg(F.sqrt(F.sum(F.col("n") * F.col("tfidf") * F.col("tfidf"))).alias("factor"))


def norms(counts: DataFrame, idf: DataFrame, parts: int = 0) -> DataFrame:
    """(fid, nk, factor) of images, from their ``counts`` and ``inverse_frequency``; images without id are left out."""
    n = F.col("n").cast("double")
    known = by_word(counts.where("fid IS NOT NULL"), idf, parts)
    sums = known.groupBy("fid").agg(F.sum("n").alias("nk"), F.sum(n * n * n * F.col("idf") * F.col("idf")).alias("cubes"))
    return sums.select("fid", "nk", (F.sqrt("cubes") / F.col("nk")).alias("factor"))


def is_small(query: DataFrame, rows: int = QUERY_ROWS) -> bool:
    """Whether rows of ``query`` (word and numbers) are few and short enough to be broadcast."""
    n, size = query.select("word").limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.col("word").cast("string")))).first()
    return n <= rows and (size or 0) <= QUERY_BYTES


def matches(query: DataFrame, index: DataFrame, rows: int = QUERY_ROWS, part: int = 100_000, by: str = "fid") -> DataFrame:
    """Rows of ``query`` (qfid, word, ...) and ``index`` (``by``, word, ...) of equal words. ``query`` is read twice."""
    if is_small(query, rows):
        return index.join(F.broadcast(query), "word")
    # A word of many images is dealt into parts of about ``part`` images; its query rows go to each.
    parts = index.groupBy("word").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("__parts")).where("__parts > 1")
    known = lambda df: df.join(parts, "word", "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    own = known(query).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    dealt = known(index).withColumn("__part", F.pmod(F.xxhash64(by), "__parts").cast("int")).drop("__parts")
    return dealt.join(own, ["word", "__part"]).drop("__part")


def similarities(query: DataFrame, weighted: DataFrame, norms: DataFrame, **options) -> DataFrame:
    """(qfid, fid, sim): the sum over matched pairs, divided by the matched image's norm only; an image whose norm is 0 is left out."""
    q = query.select(F.col("fid").alias("qfid"), "word", (F.col("n") * F.col("tfidf")).alias("wq"))
    m = weighted.select("fid", "word", (F.col("n") * F.col("tfidf")).alias("wm"))
    pairs = matches(q, m, **options).groupBy("fid", "qfid").agg(F.sum(F.col("wq") * F.col("wm")).alias("dot"))
    return pairs.join(norms, "fid").where("factor > 0").select("qfid", "fid", F.round(F.col("dot") / F.col("factor"), 6).alias("sim"))


def votes(query: DataFrame, counts: DataFrame, **options) -> DataFrame:
    """(qfid, fid, n): matched pairs of occurrences."""
    q = query.select(F.col("fid").alias("qfid"), "word", F.col("n").alias("nq"))
    return matches(q, counts, **options).groupBy("fid", "qfid").agg(F.sum(F.col("nq") * F.col("n")).alias("n")).select("qfid", "fid", "n")


def top(scored: DataFrame, k: int, score: str = "sim", larger_id_first: bool = True, group: str = "qfid", item: str = "fid") -> DataFrame:
    """The best ``k`` of each group with their rank; equal scores go by id, the larger first unless said otherwise."""
    tie = F.col(item).desc() if larger_id_first else F.col(item).asc()
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), tie)))
    return ranked.where(F.col("rank") <= k)


def named(postings: DataFrame, keypoints: DataFrame, images: DataFrame) -> DataFrame:
    """Postings with the file and path of their keypoint; postings without a known keypoint are dropped."""
    return postings.join(keypoints, "kp_id").join(images, "fid")
