"""The corpus pipeline over ``documents``: quality, toxicity, near-dedup, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``. ``run`` keeps the stages' tables in a folder of its own below the shared one.

Defined results: a null text counts as empty in every stage, a null id or source is a value like any other; null language and n_chars pass
through. Empty and very long texts are judged, compared, mixed and encoded whole. Documents alike in text (ties and repeated rows) are judged alike;
of a group of near-duplicates one row stays, that of the least id, then of the least text hash. The mix may take a row several times, and each copy
is encoded. An empty table gives empty stages; without labels the first two stages keep every row. Extra columns pass
through up to the mix, whatever their names but those that begin with two underscores; the encoding keeps doc_id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import mixing, pieces, quality, toxicity, wide_simhash
from brindle.llm.common import documents, scratch, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of a good grade is high enough."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic.

    The chain learns from the labelled rows of the source documents: the quality stage has removed the junk, one of its categories.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), source=documents(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates: wide SimHash of five-word shingles, Jaccard similarity 0.8."""
    return wide_simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of the text, with the digests of the ids and of what they decode to."""
    coded = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return pieces.digests(coded)


STAGES = [
    ("quality", select_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL has neither the models nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
