"""New image files and capture events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadframes.operators.frames import to_rgb
from roadframes.operators.metrics import analyze
from roadframes.schemas import IMAGE


def stream_captures(
    spark: SparkSession, path: str, glob: str = "*.{jpg,png}", max_files: int | None = None
) -> DataFrame:
    """Image files as they arrive; an undecodable file has height -1."""
    reader = (
        spark.readStream.format("image").schema(T.StructType([T.StructField("image", IMAGE)]))
        .option("pathGlobFilter", glob))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(images: DataFrame, edge_threshold: int = 50, **params) -> DataFrame:
    """Scores of arriving images: the batch operators on a stream."""
    return analyze(to_rgb(images), edge_threshold, **params)


def capture_slots(captures: DataFrame, every: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Captures per camera and slot; rows later than ``late`` are dropped.

    Only counts per camera and slot are kept as state, after a count in each task.
    """
    timed = captures.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    slots = timed.withWatermark("captured_at", late).groupBy(
        F.window("captured_at", every).alias("slot"), "camera").agg(F.count("*").alias("captures"))
    return slots.select("camera", F.col("slot.start").cast("timestamp_ntz").alias("slot"), "captures")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work through all available input and stop; a restart goes on where it was."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
