"""Stored frame tables and chunk folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.operators.sampling import assign_group
from roadframes.schemas import FRAMES


def scan_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path).select(*FRAMES.names)


def write_frames(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store frames in folders by source; a large source stays spread over many files."""
    df.write.mode(mode).partitionBy("source").parquet(path)


def select_frame_columns(df: DataFrame) -> DataFrame:
    """Only the pixels and the label, as a stored tensor dataset has."""
    return df.select(F.col("pixels").alias("pixel_values"), "label")


def chunked(
    df: DataFrame, chunk_size: int = 5000, order: Sequence[str] = ("frame_id",), valid: str | None = None
) -> DataFrame:
    """Chunk numbers by input position; rows that fail are dropped afterwards.

    So a chunk with failed rows is shorter, and no later row moves up.
    """
    numbered = assign_group(df, chunk_size, order, "chunk_id").drop("rn")
    return numbered.where(F.col(valid)) if valid else numbered


def write_chunks(
    df: DataFrame, path: str, chunk_size: int = 5000, order: Sequence[str] = ("frame_id",),
    valid: str | None = None, mode: str = "errorifexists",
) -> None:
    """One folder per chunk. Rows are numbered in ranges, so a chunk lies in one range, or in two
    neighbouring ones, and is written from there without another shuffle."""
    chunked(df, chunk_size, order, valid).write.mode(mode).partitionBy("chunk_id").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunk folders under ``path`` as one table with their ``chunk_id``."""
    return spark.read.parquet(path).withColumn("chunk_id", F.col("chunk_id").cast("bigint"))


def concat_chunks(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def concat_sources(parts: dict[str, DataFrame], labels: dict[str, int]) -> DataFrame:
    """Union of the sources' frames, each labelled by its source."""
    return concat_chunks([
        part.withColumns({"source": F.lit(name), "label": F.lit(labels[name])}) for name, part in parts.items()])
