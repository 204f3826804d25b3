"""Shape expressions of frames.

A frame is a flat ``pixels`` array with ``height``, ``width``, ``channels`` and
``layout`` (``HWC`` or ``CHW``) beside it. Work on the values is done by the Arrow
kernels: a lambda over an array is interpreted, and costs several times as much per
value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def layout_or_guess() -> Column:
    """The stated layout; where it is NULL, three channels are read as channels first."""
    guess = F.when(F.col("channels") == 3, F.lit("CHW")).otherwise(F.lit("HWC"))
    return F.coalesce(F.col("layout"), guess)


def has_gaps(pixels: Column) -> Column:
    """Whether a value is missing or not a number; false for missing pixels.

    One compiled search for NaN, whose answer is NULL where it finds none among values of which some are NULL.
    """
    return F.coalesce(F.array_contains(pixels, F.lit(float("nan")).cast("float")), pixels.isNotNull())
