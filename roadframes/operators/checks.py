"""Checks over whole datasets; each check is one row: name, passed, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframes.functions.pixels import has_gaps, layout_or_guess
from roadframes.operators.running import beside


def holds_tensors(df: DataFrame) -> tuple[bool, str]:
    """A dataset of raw images, with an ``image_url`` column, is not a tensor dataset."""
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema)
    return "image_url" not in df.columns and "pixels" in df.columns, kinds


def _check(name: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))


def verify_frames(df: DataFrame, expected_shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Column kinds, size, shapes and value range over all frames, in one pass."""
    tensors, kinds = holds_tensors(df)
    if not tensors:
        return df.agg(F.count("*").alias("rows")).select(F.inline(F.array(
            _check("tensors", F.lit(False), F.lit(kinds)),
            _check("size", F.col("rows") > 0, F.format_string("%d frames", "rows")))))
    channels_first = layout_or_guess() == "CHW"
    c, h, w = F.col("channels"), F.col("height"), F.col("width")
    shape = F.when(channels_first, F.concat_ws("x", c, h, w)).otherwise(F.concat_ws("x", h, w, c))
    right = F.lit(True)
    if expected_shape:
        right = (c == expected_shape[0]) & (h == expected_shape[1]) & (w == expected_shape[2])
    facts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce((F.size("pixels") == c * h * w) & right, F.lit(False))).alias("misshapen"),
        F.min(shape).alias("first"), F.max(shape).alias("last"),
        F.count_if(has_gaps(F.col("pixels"))).alias("unreadable"),
        F.min(F.array_min("pixels")).alias("low"), F.max(F.array_max("pixels")).alias("high"))

    return facts.select(F.inline(F.array(
        _check("tensors", F.lit(True), F.lit(kinds)),
        _check("size", F.col("rows") > 0, F.format_string("%d frames", "rows")),
        _check("shape", (F.col("misshapen") == 0) & (F.col("first") == F.col("last")),
              F.format_string("%s to %s, %d misshapen", "first", "last", "misshapen")),
        _check("range", F.col("unreadable") == 0,
              F.format_string(
                  "[%.3f, %.3f], %d unreadable", F.col("low").cast("double"), F.col("high").cast("double"),
                  F.col("unreadable"))))))


def verify_stored(written: DataFrame, read_back: DataFrame) -> DataFrame:
    """Whether as many rows come back as were written."""
    a, b = written.agg(F.count("*").alias("a")), read_back.agg(F.count("*").alias("b"))
    return beside(a, b).select(
        F.lit("read back").alias("name"), (F.col("a") == F.col("b")).alias("passed"),
        F.format_string("%d written, %d read", "a", "b").alias("detail"))


def verify_splits(split: DataFrame, whole: DataFrame, key: str = "frame_id") -> DataFrame:
    """Whether every frame is in exactly one split, and none is missing."""
    times = split.groupBy(key).agg(F.count("*").alias("_times"))
    both = times.join(whole.select(F.col(key).alias("_id")), F.col(key) == F.col("_id"), "full_outer")
    return both.agg(
        F.count_if(F.col("_times") > 1).alias("repeated"),
        F.count_if(F.col("_times").isNull()).alias("missing"),
        F.count_if(F.col("_id").isNull()).alias("unknown")
    ).select(
        F.lit("splits").alias("name"),
        (F.col("repeated") + F.col("missing") + F.col("unknown") == 0).alias("passed"),
        F.format_string("%d repeated, %d missing, %d unknown", "repeated", "missing", "unknown").alias("detail"))
