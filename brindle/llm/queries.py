"""One query for each operator of this folder, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import chat, exact, media, merkle, mixing, multiset, pieces, quality, sharding, simhash, token_counts, toxicity, whitening
from brindle.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pieces.digests(pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op9_mixing"] = mixing.SQL


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), shards=8)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int"), "shard": F.col("shard").cast("int"), "slot": F.col("slot").cast("long")})


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_and_read(documents(spark, sf_dir).select("doc_id", "text")))


@query
def op8_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.with_edited(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


ORACLES["op1_chat_formatting"] = chat.SQL


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.quality(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])


ORACLES["op13_exact_dedup"] = exact.SQL


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text"))


ORACLES["op11_merkle_manifest"] = merkle.SQL
