"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframes.session import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step. A node's smallest neighbour is an aggregate with map-side combining, and
    is joined back to the edges, so a node with very many neighbours is never gathered."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        moved = joined.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        moved = moved.select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the links (columns u, v): the smallest node reachable.

    Each round is a large-star and a small-star step, written to the shared folder, until
    nothing changes. Null ends and self-links are ignored; no links give no rows.
    """
    edges = materialise(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = materialise(_star(_star(edges, small=False), small=True), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)
