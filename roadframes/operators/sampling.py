"""Subsets, splits and batches: exact sizes, repeatable, without moving pixels.

Random order is an md5 of seed and frame id. A split or subset is decided by
comparing a row's hash with cut values found on ids alone, so wide rows are
filtered or labelled where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadframes.operators.running import (
    before_cut, beside, global_rank, hash_cuts, seeded_hash, small_side)
from roadframes.session import materialise


def order_by_path(df: DataFrame, path: str = "origin") -> DataFrame:
    return df.orderBy(path)


def subset(df: DataFrame, n: int | None, seed: int = 0, key: str = "frame_id") -> DataFrame:
    """``min(n, total)`` rows without replacement; a falsy ``n`` keeps all."""
    if not n:
        return df
    cut = hash_cuts(df, key, seed, {"_last": F.least(F.lit(n), F.col("n"))})
    return beside(df, cut).where(before_cut(key, seed, "_last")).select(df.columns)


def sample_k(df: DataFrame, k: int = 5, seed: int = 0, key: str = "frame_id") -> DataFrame:
    """A handful of random rows to look at."""
    return df.orderBy(seeded_hash(key, seed), key).limit(k)


def first_k(df: DataFrame, k: int = 1, order: str = "frame_id") -> DataFrame:
    return df.orderBy(order).limit(k)


def sample_grid(metrics: DataFrame, n: int = 12) -> DataFrame:
    """The first frames with their scores, for one page of review."""
    return metrics.orderBy("frame_id").limit(n).select(
        "frame_id", "traffic_level", "density", "congestion",
        F.format_string(
            "Level: %d, Density: %.2f, Cong: %.2f", "traffic_level", F.bround("density", 2), F.bround("congestion", 2)
        ).alias("title"))


def split_exact(
    df: DataFrame, train: int = 70, val: int = 15, seed: int = 0, key: str = "frame_id"
) -> DataFrame:
    """Train gets ``n*train div 100`` rows, validation ``n*val div 100``, test the rest."""
    n_train, n_val = F.floor(F.col("n") * train / 100), F.floor(F.col("n") * val / 100)
    cuts = hash_cuts(df, key, seed, {"_train": n_train, "_val": n_train + n_val})
    split = F.when(before_cut(key, seed, "_train"), "train").when(before_cut(key, seed, "_val"), "val").otherwise("test")
    return beside(df, cuts).withColumn("split", split).select(*df.columns, "split")


def split_by_source(
    df: DataFrame, holdout: int = 30, seed: int = 0, key: str = "frame_id", source: str = "source"
) -> DataFrame:
    """In each source hold out ``ceil(holdout%)`` of the rows; ``ceil`` of half of them is test."""
    n = F.col("n")
    held = F.ceil(n * holdout / 100)
    n_test = F.ceil(held / 2)
    cuts = hash_cuts(df, key, seed, {"_train": n - held, "_val": n - n_test}, [source])
    # every source of df has a row in cuts unless both its cuts are 0, hence the left join
    marked = df.join(small_side(cuts, "source-cuts"), source, "left")
    split = F.when(before_cut(key, seed, "_train"), "train").when(before_cut(key, seed, "_val"), "val").otherwise("test")
    return marked.withColumn("split", split).select(*df.columns, "split")


def assign_group(
    df: DataFrame, size: int, order: Sequence[str] = ("frame_id",), group: str = "chunk_id"
) -> DataFrame:
    """Number rows in order and cut them into groups of ``size``, from 0.

    Wide rows are shuffled once, by range, and numbered where they land: their place
    in the sorted partition, plus the rows of the partitions before it. Every row gets a
    number of its own; NULLs come first, and rows equal in the order columns in any order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_block": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    blocks = materialise(placed, "numbered")
    sizes = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    # one row for each partition
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    place = F.col("_at") - F.shiftleft(F.col("_block").cast("bigint"), 33)
    numbered = blocks.join(small_side(before, "rows-before"), "_block").withColumn("rn", place + F.col("_before") + 1)
    return numbered.withColumn(group, F.floor((F.col("rn") - 1) / size).cast("bigint")).select(*df.columns, "rn", group)


def batches(
    df: DataFrame, size: int = 32, shuffle_seed: int | None = None, key: str = "frame_id"
) -> DataFrame:
    """Batch numbers in id order, or in a seeded random order for training."""
    if shuffle_seed is None:
        return assign_group(df, size, [key], "batch_id")
    return global_rank(df, key, shuffle_seed).withColumn(
        "batch_id", F.floor((F.col("rn") - 1) / size).cast("bigint"))


def select_ids(df: DataFrame, ids: DataFrame, key: str = "frame_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")
