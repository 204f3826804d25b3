"""Frame scoring: one pass over the pixels gives integer counts, the rest is arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.functions import scoring
from roadframes.functions.pixel_udfs import CHANNEL_NAMES, COUNT_NAMES, frame_counts_udf, pixel_columns
from roadframes.operators.running import beside
from roadframes.schemas import PARAMS, SCORER_DEFAULTS

def default_params(spark: SparkSession, **changes) -> DataFrame:
    """The scorer's parameters as one row."""
    values = {**SCORER_DEFAULTS, **changes}
    return spark.createDataFrame([tuple(values[f.name] for f in PARAMS)], PARAMS)


def update_params(
    params: DataFrame, density_weight=None, congestion_weight=None, edge_threshold=None, thresholds=None
) -> DataFrame:
    """Replace the given parameters, keep the others, return the full set."""
    given = {
        "density_weight": density_weight, "congestion_weight": congestion_weight,
        "edge_threshold": edge_threshold,
        "thresholds": None if thresholds is None else F.array(*[F.lit(float(t)) for t in thresholds])}
    kinds = {f.name: f.dataType for f in PARAMS}
    return params.select(*[
        F.col(name) if value is None else
        (F.lit(value) if not hasattr(value, "cast") else value).cast(kinds[name]).alias(name)
        for name, value in given.items()])


def merge_params(params: DataFrame, update: DataFrame) -> DataFrame:
    """Update one row of parameters by another; NULL keeps the old value."""
    new = update.select(*[F.col(f.name).alias(f"_{f.name}") for f in PARAMS])
    return beside(params, new).select(*[
        F.coalesce(F.col(f"_{f.name}"), F.col(f.name)).alias(f.name) for f in PARAMS])


def frame_counts(
    frames: DataFrame, edge_threshold: int = 50, overflow: str = "clamp", normal: tuple | None = None,
    keep_pixels: bool = False, by_channel: bool = False,
) -> DataFrame:
    """Replace the pixels by the counts all scores need.

    For normalised tensors pass their (mean, std) as ``normal``: they are
    denormalised in the same pass. With ``keep_pixels`` the pixels stay beside the
    counts, which spares a join where both are wanted; ``by_channel`` adds the sums of
    R, G and B.
    """
    if overflow not in ("clamp", "wrap"):
        raise ValueError("overflow is clamp or wrap")
    counted = frames.withColumn("_c", frame_counts_udf(edge_threshold, overflow, normal, by_channel)(*pixel_columns()))
    names = COUNT_NAMES + CHANNEL_NAMES if by_channel else COUNT_NAMES
    return counted.select(
        *[c for c in frames.columns if keep_pixels or c != "pixels"],
        "_c.valid", "_c.reason", *[f"_c.{name}" for name in names])


def edge_count(frames: DataFrame, edge_threshold: int = 50) -> DataFrame:
    return frame_counts(frames, edge_threshold).select("frame_id", "px", "edge_px")


def edge_density(counts: DataFrame) -> DataFrame:
    """Edge pixels per pixel; 0 where the frame is not valid."""
    return counts.withColumn("edge_density", F.coalesce(scoring.edge_density(), F.lit(0.0)))


def density(df: DataFrame) -> DataFrame:
    return df.withColumn("density", scoring.density(F.col("edge_density")))


def congestion(counts: DataFrame, scale: float = 50.0) -> DataFrame:
    deviation = scoring.spread(F.col("px_sum"), F.col("px_sumsq"), F.col("px"))
    return counts.withColumn("congestion", F.coalesce(scoring.congestion(deviation, scale), F.lit(0.0)))


def traffic_score(metrics: DataFrame, params: DataFrame) -> DataFrame:
    """Weighted sum of density and congestion with one row of parameters."""
    joined = with_params(metrics, params)
    return joined.withColumn(
        "traffic_score", scoring.traffic_score(F.col("density_weight"), F.col("congestion_weight"))
    ).select(*[c for c in metrics.columns if c != "traffic_score"], "traffic_score")


def with_params(metrics: DataFrame, params: DataFrame) -> DataFrame:
    """Put the one row of parameters beside every row."""
    return beside(metrics, params)


def base_metrics(
    frames: DataFrame, edge_threshold: int = 50, overflow: str = "clamp", normal: tuple | None = None,
    keep_pixels: bool = False, by_channel: bool = False,
) -> DataFrame:
    """Everything that depends on pixels; store this, and re-score it as often as needed."""
    counts = congestion(density(edge_density(frame_counts(
        frames, edge_threshold, overflow, normal, keep_pixels, by_channel))))
    return counts.withColumn("flow_rate", F.col("edge_density"))


def rescore(metrics: DataFrame, params: DataFrame) -> DataFrame:
    """Score and level under new weights and thresholds; pixels are not read."""
    kept = [c for c in metrics.columns if c not in ("traffic_score", "traffic_level")]
    score = scoring.traffic_score(F.col("density_weight"), F.col("congestion_weight"))
    scored = with_params(metrics.select(*kept), params).withColumn("traffic_score", score)
    level = F.when(F.col("valid"), scoring.traffic_level(F.col("traffic_score"), F.col("thresholds"))).otherwise(0)
    return scored.withColumn("traffic_level", level).select(*kept, "traffic_score", "traffic_level")


def analyze(
    frames: DataFrame, edge_threshold: int = 50, overflow: str = "clamp", normal: tuple | None = None,
    keep_pixels: bool = False, by_channel: bool = False, **params,
) -> DataFrame:
    """All scores of each frame; a frame that cannot be read is kept with zeros and a reason.

    Weights and thresholds are plan-time values here, so this also works on a stream.
    """
    values = {**SCORER_DEFAULTS, **params}
    base = base_metrics(frames, edge_threshold, overflow, normal, keep_pixels, by_channel)
    scored = base.withColumn("traffic_score", scoring.traffic_score(
        F.lit(float(values["density_weight"])), F.lit(float(values["congestion_weight"]))))
    thresholds = F.array(*[F.lit(float(t)) for t in values["thresholds"]])
    level = F.when(F.col("valid"), scoring.traffic_level(F.col("traffic_score"), thresholds)).otherwise(0)
    return scored.withColumn("traffic_level", level)


def attach_params(frames: DataFrame, metrics: DataFrame, key: str = "frame_id") -> DataFrame:
    """Frames with their scores, one to one by id.

    This moves pixels to meet stored scores; when scoring anyway, ``analyze`` with
    ``keep_pixels`` gives the same rows without a join.
    """
    new = [c for c in metrics.columns if c == key or c not in frames.columns]
    return frames.join(metrics.select(*new), key)


def attach_scores(reviews: DataFrame, metrics: DataFrame, key: str = "frame_id") -> DataFrame:
    """Review entries with the scores of the frame they speak about."""
    return reviews.join(metrics.select(key, "traffic_level", "density", "congestion"), key)
