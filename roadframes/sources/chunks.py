"""Chunk folders found by a pattern and read as one table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadframes.schemas import FRAMES

LISTING = "path string, name string, number bigint, bytes bigint"


class NoChunks(FileNotFoundError):
    """No folder matches the pattern."""


def list_chunks(spark: SparkSession, path: str, pattern: str = "*chunk_*", order: str = "number") -> DataFrame:
    """``path, name, number, bytes, position`` of the folders under ``path`` that match, one row each.

    ``number`` is the last number in the name. ``position`` counts from 0, by number and then name (chunk 10 after chunk 2,
    names without a number last), or with ``order="text"`` by name alone (chunk 10 before chunk 2). The listing has a row for
    each folder, never for each file or frame.
    """
    if order not in ("number", "text"):
        raise ValueError(f"order by number or text, not {order!r}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
    system = at.getFileSystem(conf)
    rows = []
    for entry in system.globStatus(at) or []:
        if entry.isDirectory():
            name = entry.getPath().getName()
            numbers = re.findall(r"\d+", name)
            size = system.getContentSummary(entry.getPath()).getLength()
            rows.append((entry.getPath().toString(), name, int(numbers[-1]) if numbers else None, size))
    if not rows:
        raise NoChunks(f"no chunk folder matches {path}/{pattern}")
    by = [F.asc_nulls_last("number"), "name"] if order == "number" else ["name"]
    return spark.createDataFrame(rows, LISTING).withColumn("position", F.row_number().over(Window.orderBy(*by)) - 1)  # a row for each folder


def combine_chunks(
    spark: SparkSession, path: str, pattern: str = "*chunk_*", order: str = "number", schema: StructType | str = FRAMES,
) -> DataFrame:
    """All matching folders as one table with the declared columns, ``chunk`` (the folder's name) and its ``position``.

    Columns that a chunk's files lack are NULL; a folder without files gives no row. Without a match ``NoChunks`` is raised.
    """
    listing = list_chunks(spark, path, pattern, order)
    folders = [r["path"] for r in listing.select("path").collect()]
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)
    # file paths are encoded as in addresses, folder names are not
    named = rows.select(*rows.columns, F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("chunk"))
    return named.join(F.broadcast(listing.select(F.col("name").alias("chunk"), "position")), "chunk").select(
        *rows.columns, "chunk", "position")
