"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.llm import (
    chat, embedding_dedup, minhash_dedup, mixing, ns_clusters, packing, pii, quality_crf, quality_rules, secrets, spelling, token_files, toxicity)
from roadframes.llm.common import crc_fold, span_digest, table
from roadframes.llm.twins import TWINS
from roadframes.session import scratch_path

#: Share of tokens that each domain shall have.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: A label 1 is predicted from this score on.
CUT = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_fold(4) != 2)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(crc_fold(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit_secrets(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")),
                        F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("spans")).alias("spans"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, kind="word", end_id=2)
    return token_files.read_token_files(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.fit_quality(docs, table(spark, sf_dir, "labels"), crc_fold(5) != 0)
    return quality_crf.score_quality(docs, model).select(
        "doc_id", F.coalesce(crc_fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(table(spark, sf_dir, "documents"), percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), capacity=2048, end_id=0, kind="byte")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.concat("email", "ip", "card", "phone")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.concat(base, "iban")).alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS).withColumn(
        "rate", F.round("rate", 6))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "chats")
    chat.write_chats(chat.chat_turns(rows.union(more)), path)
    return chat.read_chats(spark, path)


def op12_ns_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = ns_clusters.ns_clusters(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, dims=64, scale=256, seed=2)
    return ns_clusters.with_inertia(assigned, centroids, spark)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least_points=5, least_n=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_secrets, op3_token_files, op4_quality, op5_quality_rules,
                            op6_minhash_dedup, op7_packing, op8_embedding_dedup, op9_pii, op10_mixing, op11_chat_format,
                            op12_ns_clusters, op13_spelling_variants)}

__all__ = ["QUERIES", "TWINS"]
