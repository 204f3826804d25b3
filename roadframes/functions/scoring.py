"""Scores from integer frame counts: pure column arithmetic, no pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadframes.schemas import LEVEL_NAMES


def spread(total: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation from a sum, a sum of squares and a count."""
    mean = F.try_divide(total.cast("double"), n)
    variance = F.try_divide(squares.cast("double"), n) - mean * mean
    return F.sqrt(F.greatest(F.lit(0.0), variance))


def edge_density() -> Column:
    return F.try_divide(F.col("edge_px").cast("double"), F.col("px"))


def density(edges: Column) -> Column:
    return F.least(F.lit(1.0), edges * 2.0)


def congestion(deviation: Column, scale: float = 50.0) -> Column:
    return F.least(F.lit(1.0), deviation / scale)


def traffic_score(density_weight: Column, congestion_weight: Column) -> Column:
    return density_weight * F.col("density") + congestion_weight * F.col("congestion")


def traffic_level(score: Column, thresholds: Column) -> Column:
    """Highest index (from 1) of the thresholds the score exceeds, 0 for none."""
    hits = F.transform(thresholds, lambda t, i: F.when(score > t, i + 1).otherwise(0))
    return F.coalesce(F.array_max(hits), F.lit(0)).cast("int")


def level_name(level: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in LEVEL_NAMES]), level)
