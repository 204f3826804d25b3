"""Review sessions as JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadframes.schemas import FEEDBACK_SESSION
from roadframes.sources.files import write_files

ENTRY = ["image_index", "model_prediction", "user_correction", "was_correct", "density", "congestion"]


def scan_feedback(spark: SparkSession, path: str, pattern: str = "*/feedback_*.json") -> tuple[DataFrame, DataFrame]:
    """Sessions from JSON files one folder deep, and the files that were skipped whole.

    A file is skipped when it is malformed or has no ``feedback`` list.
    """
    schema = T.StructType([*FEEDBACK_SESSION.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        read = spark.read.schema(schema).option("multiLine", True).json(f"{path}/{pattern}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], schema)
        read = read.withColumn("file_path", F.lit(None).cast("string"))
    else:
        read = read.withColumn("file_path", F.col("_metadata.file_path"))
    usable = F.col("_corrupt_record").isNull() & F.col("feedback").isNotNull()
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed").otherwise("no feedback")
    return (
        read.where(usable).drop("_corrupt_record"),
        read.where(~usable).select("file_path", reason.alias("reason")))


def feedback_documents(reviews: DataFrame, images: int = 12, totals: str = "page") -> DataFrame:
    """One nested document per session of at most ``images`` entries.

    ``reviews`` has ``session``, ``timestamp``, ``session_duration`` and the entry
    columns, one row per image. A session that reviewed more images than one page
    holds becomes several documents, one per page, so no document grows without bound.
    In the metadata, ``total_images`` and ``correct_predictions`` count the document's own
    entries, or with ``totals="session"`` those of the whole session in each of its documents, so that they do not
    depend on the size of a page; ``session_images`` and ``session_correct`` always count the whole session.
    """
    if totals not in ("page", "session"):
        raise ValueError(f"totals of a page or a session, not {totals!r}")
    page = F.floor(F.col("image_index") / images).cast("bigint").alias("page")
    entries = F.sort_array(F.collect_list(F.struct(*ENTRY)))
    pages = reviews.groupBy("session", page).agg(
        F.max("timestamp").alias("timestamp"),
        entries.alias("feedback"),
        F.max("session_duration").alias("session_duration"),
        F.struct(
            F.max("timestamp").alias("timestamp"),
            F.count("*").alias("total_images"),
            F.count_if("was_correct").alias("correct_predictions"),
            F.max("session_duration").alias("session_duration")).alias("metadata"))
    sums = reviews.groupBy(F.col("session").alias("__session")).agg(
        F.count("*").alias("__images"), F.count_if("was_correct").alias("__correct"))
    whole = F.col("metadata").withField("session_images", F.col("__images")).withField("session_correct", F.col("__correct"))
    if totals == "session":
        whole = whole.withField("total_images", F.col("__images")).withField("correct_predictions", F.col("__correct"))
    joined = pages.join(sums, F.col("session").eqNullSafe(F.col("__session")))
    return joined.withColumn("metadata", whole).select(pages.columns)


def write_feedback(
    reviews: DataFrame, path: str, images: int = 12, one_file_each: bool = False, totals: str = "page",
) -> None:
    """Store review sessions as JSON documents.

    By default many documents share a file, one per line. ``one_file_each`` writes
    ``<session>_<page>/feedback_<timestamp>.json``, the form ``scan_feedback`` looks for.
    """
    documents = feedback_documents(reviews, images, totals)
    if not one_file_each:
        documents.write.json(path)
        return
    name = F.format_string("%s_%d/feedback_%s.json", F.col("session").cast("string"), F.col("page"), "timestamp")
    body = F.to_json(F.struct("timestamp", "feedback", "session_duration", "metadata"))
    write_files(documents.select(name.alias("name"), body.alias("content")), path)
