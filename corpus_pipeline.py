"""A training corpus from raw documents: judge, deduplicate, redact, mix, pack.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
a DataFrame, which ``run`` writes as Parquet to the shared scratch folder and reads again
as the next one's docs. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.llm import minhash_dedup, mixing, packing, quality_crf, secrets
from roadframes.llm.catalog import CUT, TARGETS
from roadframes.llm.common import table
from roadframes.session import materialise

#: No stage is plain SQL from end to end.
ORACLE_SQL = None


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    model = quality_crf.fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality_crf.keep_good(docs, model, CUT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more."""
    found = minhash_dedup.near_copies(docs, percent=80)
    copies = found.where("not kept and doc_id is not null").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = (docs["doc_id"].cast("long") == copies["__id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == copies["__key"])
    return docs.join(copies, same, "left_anti").dropDuplicates(["doc_id", "text"])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return secrets.redact_secrets(docs, secrets.fit_secrets(docs))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that domains have their target shares of tokens."""
    return mixing.draw(docs, table(spark, sf_dir, "labels"), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.best_fit_packing(docs, capacity=2048, end_id=0, kind="byte")


STAGES = [("quality", judge_quality), ("near_copies", drop_near_copies), ("secrets", mask_secrets),
          ("mixing", mix_domains), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
