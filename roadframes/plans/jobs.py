"""The three ways in: prepare a dataset, score and summarise it, learn from reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.functions.names import parse_capture_name
from roadframes.operators import checks, summary
from roadframes.operators import frames as fr
from roadframes.operators.feedback import flatten_feedback, learn_params
from roadframes.operators.ingest import image_tensors
from roadframes.operators.metrics import analyze, rescore
from roadframes.operators.sampling import sample_grid, subset
from roadframes.schemas import FRAMES, IMAGENET_MEAN, IMAGENET_STD
from roadframes.sources.feedback import scan_feedback
from roadframes.sources.frames import scan_frames
from roadframes.sources.images import scan_images
from roadframes.sources.routed import write_routed

NORMAL = (IMAGENET_MEAN, IMAGENET_STD)


def prepare_dataset(
    spark: SparkSession, images: str, out: str, size: int = 224, region: Sequence[int] | None = None,
    source: str = "unknown",
) -> tuple[DataFrame, DataFrame]:
    """Image folder to stored tensors in one pass; returns the checks and the stored rejects.

    See ``ingest``; the rejects are read from where it stored them.
    """
    ingest(spark, images, out, size, region, source)
    return checks.verify_frames(scan_frames(spark, out), (3, size, size)), scan_rejects(spark, out)


def ingest(
    spark: SparkSession, images: str, out: str, size: int = 224, region: Sequence[int] | None = None,
    source: str = "unknown",
) -> dict[str, int]:
    """Store tensors under ``out`` and rejects under ``out`` + ``_rejects``; returns how many of each.

    Each image is decoded once and one write stores both. Frames are cropped to ``region`` (x, y, width,
    height). An image that cannot be decoded, that the region exceeds, or whose bytes do not fit
    its shape is a reject. The source is the camera in the file name. Ids are given as rows
    are written and do not change afterwards.
    """
    tensors = fr.constant_label(image_tensors(scan_images(spark, images), size, region)).withColumns({
        "frame_id": F.monotonically_increasing_id(),
        "source": F.coalesce(parse_capture_name(F.col("origin"))["camera"], F.lit(source))})
    outcome = F.when(F.col("reason").isNull(), "kept").otherwise("rejected")
    return write_routed(
        tensors.select(*FRAMES.names, "origin", "reason"), outcome, {"kept": out, "rejected": _rejects(out)})


def _rejects(out: str) -> str:
    return out.rstrip("/") + "_rejects"


def scan_rejects(spark: SparkSession, out: str) -> DataFrame:
    """``origin, reason`` of the images that ``ingest`` rejected."""
    return spark.read.schema("origin string, reason string").parquet(_rejects(out)).select("origin", "reason")


def score_dataset(
    spark: SparkSession, frames: str, out: str, sample: int | None = None, seed: int = 0,
    normal: tuple | None = NORMAL, **options,
) -> DataFrame:
    """Score stored frames, or a sample of them, and store the scores; no pixels are kept."""
    chosen = subset(scan_frames(spark, frames), sample, seed)
    analyze(chosen, normal=normal, **options).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def summaries(metrics: DataFrame) -> dict[str, DataFrame]:
    """Histograms, level counts and a page of samples from stored scores."""
    return {
        "distributions": summary.distributions(metrics),
        "levels": summary.level_counts(metrics),
        "samples": sample_grid(metrics)}


def learn_from_feedback(spark: SparkSession, metrics: DataFrame, feedback: str) -> tuple[DataFrame, DataFrame]:
    """Parameters learnt from stored sessions, and all stored scores under them."""
    sessions, _ = scan_feedback(spark, feedback)
    params = learn_params(flatten_feedback(sessions))
    return params, rescore(metrics, params)
