"""Image folders in, cropped images out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.functions.names import cropped_name
from roadframes.schemas import CAMERAS
from roadframes.sources.files import write_png_files


def scan_images(
    spark: SparkSession, path: str, glob: str = "*.{jpg,png}", recursive: bool = False, drop_invalid: bool = False
) -> DataFrame:
    """All images of a folder as decoded rows; an undecodable file has height -1."""
    return (
        spark.read.format("image")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("dropInvalid", str(drop_invalid).lower())
        .load(path))


def image_rejects(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded images, and the paths of files that could not be decoded."""
    bad = F.coalesce(F.col("image.height") < 0, F.lit(True))
    return images.where(~bad), images.where(bad).select(
        F.col("image.origin").alias("origin"), F.lit("cannot decode image").alias("reason"))


def resolve_image_column(df: DataFrame) -> DataFrame:
    """Call the image column ``image``: it may be stored as ``image_url`` or ``image``."""
    for name in ("image_url", "image"):
        if name in df.columns:
            return df.select(*[c for c in df.columns if c not in ("image_url", "image")], F.col(name).alias("image"))
    raise ValueError("no image or image_url column")


def write_image_files(df: DataFrame, path: str, name: str = "name") -> None:
    """Write 8-bit channels-last frames as PNG files named by a column."""
    write_png_files(df, path, name)


def crops(df: DataFrame) -> DataFrame:
    """Give each cropped frame the file name of its crop."""
    return df.withColumn("origin", cropped_name(F.col("origin")))


def write_crops(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store cropped frames, under their crop names, as a table."""
    crops(df).write.mode(mode).parquet(path)


def camera_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, "camera string, url string")
