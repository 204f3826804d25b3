"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised to int8 with a scale of their own. For
two vectors x, y with quantised forms q(x), q(y) and errors e(x), e(y),
|<x,y> - <q(x),q(y)>| <= |q(x)||e(y)| + |e(x)||q(y)| + |e(x)||e(y)|. Tiles of quantised
vectors are multiplied in exact integer arithmetic; only pairs whose product plus
bound reaches the threshold are computed again in double precision. So no pair is
missed and none below the threshold is linked.

Equal vectors are one class with a count. A pair of tiles is one group of at most
2 x ``tile`` vectors, and gives link counts and a spanning forest, never its pairs.
The tile products are quadratic in the number of different vectors by this method; the
work divides evenly over the groups whatever the data look like.

Vectors that are null, zero or hold null or non-finite values, or whose length differs from
the others' of a tile, link with nothing. Repeated rows count as vectors of their own.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframes.llm.common import bounded_batches
from roadframes.llm.components import components
from roadframes.session import materialise

#: Room for rounding in double precision, far below any difference that matters.
SLACK = 1e-9
#: Rows of one tile that are compared at a time: bounds the product's memory.
STRIPE = 512


def usable(vector: Column) -> Column:
    """Finite values only, none missing, and one of them not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


class Quantised:
    """Unit vectors, their int8 codes (kept as floats for the product), and error norms."""

    def __init__(self, x: np.ndarray):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.scale = np.abs(self.unit).max(axis=1) / 127
        codes = np.rint(self.unit / self.scale[:, None])
        back = codes * self.scale[:, None]
        self.codes = codes.astype(np.int8)
        self.norm = np.linalg.norm(back, axis=1)
        self.error = np.linalg.norm(self.unit - back, axis=1)


def linked_pairs(a: Quantised, b: Quantised, threshold: float):
    """Pairs at or above the threshold, a stripe of rows at a time, as positions in a and in b."""
    right = b.codes.astype(np.float32).T  # sums stay below 2**24, so float32 products are exact integers
    for i in range(0, len(a.codes), STRIPE):
        s = slice(i, i + STRIPE)
        product = a.codes[s].astype(np.float32) @ right
        reach = threshold - SLACK - ((a.norm[s] + a.error[s]) * b.error.max() + a.error[s] * b.norm.max())
        least = np.where(reach > 0, reach / (a.scale[s] * b.scale.max()), reach / (a.scale[s] * b.scale.min()))
        p, q = np.nonzero(product >= (least - 1).astype(np.float32)[:, None])
        if not len(p):
            continue
        near = product[p, q] * a.scale[s][p] * b.scale[q]
        bound = (a.norm[s][p] + a.error[s][p]) * b.error[q] + a.error[s][p] * b.norm[q]
        maybe = near + bound >= threshold - SLACK
        p, q = p[maybe], q[maybe]
        for k in range(0, len(p), 1 << 16):
            u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            exact = np.einsum("ij,ij->i", a.unit[s][u], b.unit[v]) >= threshold
            yield u[exact] + i, v[exact]


class Forest:
    """Disjoint sets over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def _tile_pair(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        a, b, side = (group.column(c).to_numpy() for c in ("a", "b", "tile"))
        ids, weight = group.column("class_id").to_numpy(), group.column("n").to_numpy()
        flat = group.column("vector").combine_chunks()
        size = np.diff(flat.offsets.to_numpy())
        values = flat.flatten().to_numpy().astype(np.float64)
        n = len(ids)
        links, forest = np.zeros(n, dtype=np.int64), Forest(n)
        edges: list[tuple[int, int]] = []
        first = np.concatenate([[0], np.cumsum(size)])
        for dim in np.unique(size):
            left = np.flatnonzero((side == a[0]) & (size == dim))
            right = np.flatnonzero((side == b[0]) & (size == dim))
            if not len(left) or not len(right):
                continue
            vectors = lambda rows, d=dim: Quantised(values[first[rows][:, None] + np.arange(d)])
            x = vectors(left)
            y = x if a[0] == b[0] else vectors(right)
            for p, q in linked_pairs(x, y, threshold):
                p, q = left[p], right[q]
                if a[0] == b[0]:
                    p, q = p[p != q], q[p != q]  # each pair shows twice within one tile
                    np.add.at(links, p, weight[q])
                    p, q = p[p < q], q[p < q]
                else:
                    np.add.at(links, p, weight[q])
                    np.add.at(links, q, weight[p])
                for i, j in zip(p.tolist(), q.tolist(), strict=True):
                    if forest.join(i, j):
                        edges.append((i, j))
        some = np.flatnonzero(links)
        u, v = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
        null = np.full(len(some), None)
        return pa.table({
            "u": pa.array(np.concatenate([ids[some], ids[u]]), pa.int64()),
            "v": pa.array([*null, *ids[v]], pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(u), dtype=np.int64)]), pa.int64())})

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, tile: int = 4096,
                    least_tiles: int = 12) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row. Tiles hold about ``tile`` vectors, fewer
    where that would leave less than ``least_tiles`` of them."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("vector"))
    rows = rows.withColumn("fine", usable(F.col("vector")))
    rows = rows.withColumn("key", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    classes = rows.where("fine").groupBy("key").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("class_id"), "*"), "classes")
    total = classes.count()
    tiles = max(least_tiles, -(-total // tile))
    placed = classes.select("class_id", "n", "vector", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int").alias("tile"))
    # every pair of tiles is one group: a vector goes to one group for each tile
    grid = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "class_id", "n", "vector")
    found = materialise(
        grid.groupBy("a", "b").applyInArrow(_tile_pair(threshold), "u long, v long, links long"), "tile_links")
    counted = found.where("v is null").groupBy(F.col("u").alias("class_id")).agg(F.sum("links").alias("links"))
    parts = components(found.where("v is not null").select("u", "v"))
    labelled = classes.select("class_id", "key", "n", "least").join(counted, "class_id", "left").join(
        parts.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn(
        "component", F.coalesce("component", "class_id"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(labelled, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

