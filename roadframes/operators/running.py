"""Exact running aggregates and ranks that split a hot group into ordered blocks.

A plain window sorts a whole group in one task. Here each group is cut into
blocks that follow the order (an hour, a hash prefix, a sorted range). Rows are
scanned inside their block; the blocks' totals, one small row each, are scanned
across the group; the two are added. Nothing but totals ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadframes.session import materialise

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of a one-row table beside every row.

    The row is a scalar subquery: worked out once, then a constant in the plan of
    ``df``. More than one row is an error, none gives NULLs.
    """
    row = one.select(F.struct(*one.columns)).scalar()
    return df.select("*", *[row[name].alias(name) for name in one.columns])


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    values: dict[str, tuple[str, str]],
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates over each group of ``keys`` in ``order``.

    ``values`` maps an output name to ``(aggregate, column)``; the aggregates are
    sum, count, min and max. ``block`` must not fall as ``order`` rises. With
    ``exclusive`` the current row is left out. ``order`` must be unique inside a group;
    keys and block must not be NULL.
    """
    group = [*keys, block]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)

    local = df.withColumns({
        f"_in_{name}": AGGREGATES[how](column).over(inside) for name, (how, column) in values.items()})
    totals = df.groupBy(*group).agg(*[
        AGGREGATES[how](column).alias(f"_of_{name}") for name, (how, column) in values.items()])
    carried = totals.select(*group, *[
        (F.sum if how == "count" else AGGREGATES[how])(f"_of_{name}").over(across).alias(f"_to_{name}")
        for name, (how, _) in values.items()])

    def together(name: str, how: str) -> Column:
        before, here = F.col(f"_to_{name}"), F.col(f"_in_{name}")
        if how == "min":
            return F.least(before, here)
        if how == "max":
            return F.greatest(before, here)
        both = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        if how == "count":
            return both
        return F.when(before.isNotNull() | here.isNotNull(), both)

    return local.join(carried, group).select(
        *df.columns, *[together(name, how).alias(name) for name, (how, _) in values.items()])


def seeded_hash(key: str | Column, seed: int = 0) -> Column:
    """A random but repeatable order: md5 of the seed and the key, as hex text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_block(digest: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits: 4,096 even blocks that follow the hash order."""
    return F.substring(digest, 1, hex_digits)


def global_rank(df: DataFrame, key: str = "frame_id", seed: int = 0, rank: str = "rn") -> DataFrame:
    """Exact ``1..n`` in the seeded random order of a unique ``key``.

    Select the key and narrow columns first: the rows are shuffled once.
    """
    hashed = df.withColumn("_hash", seeded_hash(key, seed)).withColumn("_block", hash_block(F.col("_hash")))
    ranked = running(hashed, [], "_block", ["_hash", key], {rank: ("count", key)})
    return ranked.drop("_hash", "_block")


def ordered_rank(df: DataFrame, order: Sequence[str], rank: str = "rn") -> DataFrame:
    """Exact ``1..n`` in the order of columns that are unique together.

    Spark's range partitioning cuts the sorted blocks, also inside a hot leading
    value; they are written to the shared folder, so that block numbers cannot
    change when a lost executor's work is repeated.
    """
    cut = df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id())
    blocks = materialise(cut, "ordered-rank")
    return running(blocks, [], "_block", list(order), {rank: ("count", order[0])}).drop("_block")


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str = "_block") -> DataFrame:
    """Number blocks that follow ``order`` inside each group of ``keys`` and hold about the same number of rows.

    The blocks are Spark's ranges, whose borders are quantiles of a sample, so a group that is hot, however short its
    time, is cut into many of them. They are written to the shared folder, so that a repeated task finds the same borders.
    """
    return materialise(df.repartitionByRange(*keys, *order).withColumn(block, F.spark_partition_id()), "ordered-blocks")


def hash_cuts(
    df: DataFrame,
    key: str,
    seed: int,
    cuts: dict[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Where a seeded random order is to be cut, per group of ``keys``.

    ``cuts`` maps a name to a row count, as an expression over the group's size
    ``n``. The result has one row per group and, per cut, the (hash, key) pair of
    the last row before it, NULL when the count is 0. Only counts per hash block
    and the rows of the blocks that hold a cut are shuffled.
    """
    digest = seeded_hash(key, seed)
    hashed = df.select(*keys, F.col(key).alias("_key"), digest.alias("_hash"), hash_block(digest).alias("_block"))
    blocks = hashed.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    group = Window.partitionBy(*keys)
    sized = blocks.select(
        *keys, "_block", "_rows",
        F.sum("_rows").over(group.orderBy("_block")).alias("_upto"),
        F.sum("_rows").over(group).alias("n"))
    points = F.explode(F.array(*[
        F.struct(F.lit(name).alias("cut"), count.cast("bigint").alias("at")) for name, count in cuts.items()]))
    held = sized.withColumn("_cut", points).select(
        *keys, "_block", F.col("_cut.cut").alias("cut"),
        (F.col("_cut.at") - F.col("_upto") + F.col("_rows")).alias("_nth"), "_rows",
    ).where("_nth between 1 and _rows")
    # without keys there are at most len(cuts) rows here
    held_side = held if keys else F.broadcast(held)
    in_block = Window.partitionBy(*keys, "_block", "cut").orderBy("_hash", "_key")
    found = hashed.join(held_side, [*keys, "_block"]).withColumn(
        "_rn", F.row_number().over(in_block)).where("_rn = _nth")
    pairs = [
        F.max(F.when(F.col("cut") == name, F.struct(F.col("_hash").alias("hash"), F.col("_key").alias("key")))).alias(name)
        for name in cuts]
    return found.groupBy(*keys).agg(*pairs) if keys else found.agg(*pairs)


def before_cut(key: str, seed: int, cut: str) -> Column:
    """Whether a row lies at or before the cut found by ``hash_cuts``."""
    here = F.struct(seeded_hash(key, seed).alias("hash"), F.col(key).alias("key"))
    return F.coalesce(here <= F.col(cut), F.lit(False))


def small_side(df: DataFrame, name: str, max_rows: int = 100_000) -> DataFrame:
    """Store a derived table and broadcast it if its counted size allows.

    Beyond ``max_rows`` the stored table is returned without a hint: the join is
    then a shuffled one, whose skewed partitions adaptive execution splits.
    """
    stored = materialise(df, name)
    return F.broadcast(stored) if stored.count() <= max_rows else stored
