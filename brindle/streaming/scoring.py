"""Scoring arriving query images against the static index, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(queries: DataFrame, weighted: DataFrame, norms: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(qfid, window, fid, sim) of a stream (qfid, word, n, tfidf, ts) joined with the index (fid, word, n, tfidf) and its norms.

    A stream-static join; sums are kept for each query and event-time window until the watermark has passed.
    """
    index = weighted.select("fid", "word", (F.col("n") * F.col("tfidf")).alias("wm")).join(norms.where("factor > 0"), "fid")
    pairs = queries.withWatermark("ts", watermark).join(index, "word")
    score = F.sum(F.col("n") * F.col("tfidf") * F.col("wm") / F.col("factor"))
    return pairs.groupBy("qfid", F.window("ts", watermark).alias("window"), "fid").agg(F.round(score, 6).alias("sim"))


def start(scored: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends final scores to Parquet; with ``once`` what is there now is processed and the stream ends."""
    writer = scored.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
