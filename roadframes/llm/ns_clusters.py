"""Exact k-means over integer vectors, with ns-bounds.

Vectors become integers (``floor(scale * x)``), so distances, sums and means are exact and no
order of rows or tasks changes a result. The centroids of all rounds are kept: at most
``clusters * (rounds + 1)`` vectors, whatever the number of rows.

A row's state is its centroid, an upper bound of the distance to it, and for each group of
centroids a lower bound of the distance to the group's nearest other centroid, each with the round
in which it was worked out. A later round loosens a bound by the norm of the centroid's total
displacement since that round (for a group the largest of its members'), read off the kept
history; displacements of single rounds are never added up, so a centroid that wanders and returns
loosens nothing. Where the upper bound stays below a group's lower bound no member can be nearer.
Otherwise the distance to the row's own centroid is worked out exactly, and the groups that may
still hold a nearer or equal centroid are scanned exactly. Ties go to the smaller number.

A round reads the state of the round before, writes its own to the shared folder, and adds up
sums by task and cluster; the driver sees one row for each cluster and component.

Kept are vectors of exactly ``dims`` components, none null or not finite; others give no row.
Integers beyond 2**27 either way are set to that bound, so that squared distances fit 64 bits. Null ids
count as empty text in the choice of the first centroids, where rows of equal ids are ordered by
their components. Repeated rows are rows of their own. With fewer kept rows than ``clusters``
there are as many clusters as rows; an empty table gives no rows. Other columns are not read. A sum of
distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.llm.common import over_batches
from roadframes.session import materialise

#: Components stay within this, either way.
LARGEST = 1 << 27
#: Below this, products of whole numbers are exact in double precision: 64 * (2 * 2**22)**2 = 2**52.
SMALL = 1 << 22
#: Room for the rounding of roots and sums of bounds, relative.
ROOM = 1e-9
STATE = "vec_id long, codes array<int>, cluster int, upper double, upper_at int, lower array<double>, lower_at array<int>"


def kept_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id, codes``: the vectors that can be clustered, as integers."""
    values = F.transform(vectors["embedding"], lambda v: v.cast("double"))
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), values.alias("values"),
                          F.coalesce((F.size(values) == dims) & fine, F.lit(False)).alias("fine"))

    def code(v: Column) -> Column:
        return F.floor(F.greatest(F.least(scale * v, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")

    return rows.where("fine").select("vec_id", F.transform("values", code).alias("codes"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of ``seed:vec_id``, in the order of these."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(key.alias("key"), "codes").orderBy("key", "codes").limit(clusters).collect()
    return np.array([r["codes"] for r in chosen], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids, as int64."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), dtype=np.int64)
    if x.shape[1] <= 64 and max(np.abs(x).max(), np.abs(c).max()) <= SMALL:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


@dataclass
class History:
    """Centroids by round (round, centroid, component), and the groups that centroids are dealt to."""

    centroids: np.ndarray
    groups: list[np.ndarray]

    @classmethod
    def start(cls, first: np.ndarray, group_size: int) -> History:
        """Groups of centroids that lie near each other: in turn, the nearest ones of the smallest left over."""
        left, groups = list(range(len(first))), []
        while left:
            own = squared(first[left[:1]], first[left])[0]
            near = [left[k] for k in np.argsort(own, kind="stable")[:group_size]]
            groups.append(np.array(sorted(near)))
            left = [k for k in left if k not in near]
        return cls(first[None], groups)

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """Displacement norms from each round to the last one: by (round, centroid), and the largest by (round, group)."""
        gone = np.sqrt(((self.centroids - self.centroids[-1]).astype(np.float64) ** 2).sum(2)) * (1 + ROOM)
        return gone, np.stack([gone[:, g].max(1) for g in self.groups], axis=1)


def advance(x: np.ndarray, state: dict | None, history: History) -> tuple[dict, int]:
    """The state of some rows in the last round of the history, and how many distances were worked out."""
    now, c, groups = len(history.centroids) - 1, history.centroids[-1], history.groups
    n = len(x)
    if state is None:
        d = squared(x, c)
        own = d.argmin(1)
        nearest = d[np.arange(n), own]
        d[np.arange(n), own] = np.iinfo(np.int64).max
        lower = np.stack([_root(d[:, g].min(1)) for g in groups], axis=1)
        return {"cluster": own, "upper": _root(nearest), "upper_at": np.full(n, now),
                "lower": lower, "lower_at": np.full((n, len(groups)), now)}, n * len(c)
    gone, group_gone = history.moved()
    out = {k: v.copy() for k, v in state.items()}
    own = out["cluster"]
    here = np.arange(len(groups))
    loose_up = (state["upper"] + gone[state["upper_at"], own]) * (1 + ROOM)
    loose_low = state["lower"] * (1 - ROOM) - group_gone[state["lower_at"], here[None, :]]
    doubt = np.flatnonzero((loose_up[:, None] >= loose_low).any(1))
    if not len(doubt):
        return out, 0
    member = np.zeros(len(c), dtype=np.int64)
    for k, g in enumerate(groups):
        member[g] = k
    rows, was = x[doubt], own[doubt]
    kept_distance = ((rows - c[was]) ** 2).sum(1)
    best, at = kept_distance.copy(), was.copy()
    made = len(doubt)
    up, low = _root(kept_distance), loose_low[doubt]
    scan = up[:, None] * (1 + ROOM) >= low
    minima: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, g in enumerate(groups):
        some = np.flatnonzero(scan[:, k])
        if not len(some):
            continue
        d = squared(rows[some], c[g])
        made += d.size
        minima.append((k, some, d))
        first = d.argmin(1)
        value, number = d[np.arange(len(some)), first], g[first]
        wins = (value < best[some]) | ((value == best[some]) & (number < at[some]))
        best[some[wins]], at[some[wins]] = value[wins], number[wins]
    # lower bounds: exact ones of scanned groups leave out the new own centroid ...
    lower, lower_at = out["lower"], out["lower_at"]
    for k, some, d in minima:
        d = np.where(groups[k][None, :] == at[some][:, None], np.iinfo(np.int64).max, d)
        lower[doubt[some], k], lower_at[doubt[some], k] = _root(d.min(1)), now
    # ... and where the own centroid was left, its group's bound must hold for it as well
    left = np.flatnonzero((at != was) & ~scan[np.arange(len(doubt)), member[was]])
    if len(left):
        k = member[was[left]]
        lower[doubt[left], k] = np.minimum(low[left, k], up[left])
        lower_at[doubt[left], k] = now
    out["cluster"][doubt], out["upper"][doubt], out["upper_at"][doubt] = at, _root(best), now
    return out, made


def _root(d: np.ndarray) -> np.ndarray:
    return np.where(d == np.iinfo(np.int64).max, np.inf, np.sqrt(d.astype(np.float64)))


def _codes(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("codes").flatten().to_numpy().reshape(batch.num_rows, dims).astype(np.int64)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


def _step(rows: DataFrame, history: History, dims: int, first: bool) -> DataFrame:
    """State of all rows in the last round of the history."""
    width = len(history.groups)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        state = None
        if not first:
            state = {c: batch.column(c).to_numpy().copy() for c in ("cluster", "upper", "upper_at")}
            state |= {c: batch.column(c).flatten().to_numpy().reshape(-1, width) for c in ("lower", "lower_at")}
        new, _ = advance(_codes(batch, dims), state, history)
        return pa.RecordBatch.from_arrays([
            batch.column("vec_id"), batch.column("codes"), pa.array(new["cluster"], pa.int32()),
            pa.array(new["upper"], pa.float64()), pa.array(new["upper_at"], pa.int32()),
            _lists(new["lower"], pa.float64()), _lists(new["lower_at"], pa.int32())],
            ["vec_id", "codes", "cluster", "upper", "upper_at", "lower", "lower_at"])

    return over_batches(rows, run, STATE)


def cluster_sums(state: DataFrame, dims: int) -> DataFrame:
    """``cluster, component, total, n``: added up in each batch first, then by key."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, x = batch.column("cluster").to_numpy(), _codes(batch, dims)
        order = np.argsort(own, kind="stable")
        found, start = np.unique(own[order], return_index=True)
        totals = np.add.reduceat(x[order], start, axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(np.diff([*start, len(own)]), pa.int64()), _lists(totals, pa.int64())],
            ["cluster", "n", "totals"])

    parts = over_batches(state.select("cluster", "codes"), run, "cluster int, n long, totals array<long>")
    return parts.select("cluster", "n", F.posexplode("totals").alias("component", "total")).groupBy(
        "cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def next_centroids(now: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Floor of the means; a cluster without rows keeps its centroid. ``sums`` has clusters x components rows."""
    out = now.copy()
    for r in sums.collect():
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def ns_clusters(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2,
                group_size: int = 10) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, codes, cluster, distance`` of every kept vector, and the final centroids."""
    if dims > 127:
        raise ValueError("squared distances of more than 127 components may not fit 64 bits")
    rows = materialise(kept_vectors(vectors, dims, scale), "codes")
    first = first_centroids(rows, clusters, seed)
    if not len(first):
        return rows.select("vec_id", "codes", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), first
    history, state = History.start(first, group_size), rows
    for k in range(rounds + 1):
        state = materialise(_step(state, history, dims, first=not k), f"ns_round_{k}")
        if k < rounds:
            new = next_centroids(history.centroids[-1], cluster_sums(state, dims))
            history = History(np.concatenate([history.centroids, new[None]]), history.groups)
    last = history.centroids[-1]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("cluster").to_numpy()
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("codes"), batch.column("cluster"),
             pa.array(((_codes(batch, dims) - last[own]) ** 2).sum(1), pa.int64())], ["vec_id", "codes", "cluster", "distance"])

    return over_batches(state.select("vec_id", "codes", "cluster"), measure,
                        "vec_id long, codes array<int>, cluster int, distance long"), last


def with_inertia(assigned: DataFrame, centroids: np.ndarray, spark: SparkSession) -> DataFrame:
    """Sums of distances by cluster and over all, and each cluster's digest; the joined tables have a row for each cluster."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_sum"))
    whole = sums.agg(F.sum("cluster_sum").alias("whole_sum"))
    digests = spark.createDataFrame(
        [(k, centroid_digest(c)) for k, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sizes = sums.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(whole))  # one row on the right
    return assigned.join(F.broadcast(sizes), "cluster").select(
        "vec_id", "cluster", "distance", F.expr("try_cast(cluster_sum AS bigint)").alias("cluster_inertia"),
        F.expr("try_cast(whole_sum AS bigint)").alias("inertia"), "centroid_sha256")
