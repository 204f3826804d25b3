"""Clusters by bounds beside plain exact rounds."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadframes.llm import ns_clusters as ns
from roadframes.llm.catalog import op12_ns_clusters

NAMES = "vec_id long, embedding array<double>, cluster string, codes long, upper string"


def plain(rows, clusters, rounds, dims, scale=256, seed=2):
    """(vec_id, cluster, distance) and centroids, in Python whole numbers."""
    fine = [(i, [max(-ns.LARGEST, min(ns.LARGEST, math.floor(scale * x))) if abs(scale * x) < 1e15 else (
        ns.LARGEST if x > 0 else -ns.LARGEST) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(
        x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(fine, key=key)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min(range(len(cents)), key=lambda k: (far(v, cents[k]), k)) for _, v in fine]
    for _ in range(rounds):
        own = assign()
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(fine, own, strict=True) if o == k]
            if mine:
                cents[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, o, far(v, cents[o])) for (i, v), o in zip(fine, assign(), strict=True)], cents


def odd_rows(dims):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=dims) + (k % 7)).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(150)] + [rows[4]] * 3 + [(None, rows[5][1]), (None, rows[6][1])]
    bad = [None, [], [0.5] * (dims - 1), [None] + [0.5] * (dims - 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1)]
    return rows + [(2000 + k, v) for k, v in enumerate(bad)] + [(3000, [0.0] * dims), (3001, [-1e300] + [1e300] * (dims - 1))]


@pytest.mark.parametrize("clusters,rounds,dims", [(12, 5, 6), (5, 3, 3), (900, 2, 2)])
def test_like_plain_rounds(spark, clusters, rounds, dims):
    rows = odd_rows(dims)
    df = spark.createDataFrame([(i, v, "x", k, None) for k, (i, v) in enumerate(rows)], NAMES).repartition(4)
    got, cents = ns.ns_clusters(df, clusters, rounds, dims, group_size=3)
    want, plain_cents = plain(rows, clusters, rounds, dims)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=order) == sorted(want, key=order)
    assert cents.tolist() == plain_cents


@settings(max_examples=80, deadline=None)
@given(seed=st.integers(0, 10**6), size=st.sampled_from([1, 2, 5, 40]), spread=st.sampled_from([2, 40, 2**27]))
def test_bounds_are_exact_and_save_distances(seed, size, spread):
    """Ties are frequent with a small spread; the last one goes beyond exact products in double precision."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, size=(60, 3))
    history, state = ns.History.start(x[:8].astype(np.int64), size), None
    for _ in range(6):
        state, made = ns.advance(x, state, history)
        d = ns.squared(x, history.centroids[-1])
        assert (state["cluster"] == d.argmin(1)).all() and made <= 60 * 9
        new = history.centroids[-1].copy()
        for k in range(8):
            if (state["cluster"] == k).any():
                new[k] = x[state["cluster"] == k].sum(0) // (state["cluster"] == k).sum()
        history = ns.History(np.concatenate([history.centroids, new[None]]), history.groups)


def test_total_displacement_and_savings():
    """A centroid that returns loosens nothing, and settled rows cost no distance."""
    rng = np.random.default_rng(1)
    middle = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    x = (middle[rng.integers(0, 4, 400)] + rng.integers(-20, 21, (400, 2))).astype(np.int64)
    history = ns.History.start(middle.astype(np.int64), 2)
    state, made = ns.advance(x, None, history)
    assert made == 1600
    for shift in (300, 0):
        history = ns.History(np.concatenate([history.centroids, (middle + shift)[None]]), history.groups)
    gone, by_group = history.moved()
    assert gone[0].max() == 0 and by_group[0].max() == 0 and gone[1].min() > 400
    assert ns.advance(x, state, history)[1] == 0


def test_query_and_twin(spark):
    import duckdb

    from roadframes.llm.twins import TWINS

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = op12_ns_clusters(spark, sf)
    want = con.execute(TWINS["op12_ns_clusters"]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want[names].itertuples(index=False, name=None))


def test_empty(spark):
    df = spark.createDataFrame([], NAMES)
    got, cents = ns.ns_clusters(df)
    assert not len(cents) and ns.with_inertia(got, cents, spark).count() == 0
