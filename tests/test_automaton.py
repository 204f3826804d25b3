"""Machines decoded in parallel beside the same machine step by step."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadframes.operators import automaton as am
from roadframes.operators import feedback as fb

import numpy as np


def prompt(keys):
    """The review prompt as a loop: (action, level) said at each key."""
    out, keys = [], iter(keys)
    for key in keys:
        if key in ("y", "1"):
            out.append(("agree", None))
        elif key in ("n", "0"):
            out.append(None)
            for answer in keys:
                if answer in ("0", "1", "2", "3", "4"):
                    out.append(("disagree", int(answer)))
                    break
                if answer == "b":
                    out.append(None)
                    break
                if answer == "q":
                    out.append(("quit", None))
                    return out
                out.append(None)
        elif key == "b":
            out.append(("back", None))
        elif key == "q":
            out.append(("quit", None))
            return out
        else:
            out.append(None)
    return out


@settings(max_examples=300, deadline=None)
@given(groups=st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=40), min_size=1, max_size=4), seed=st.integers(0, 99))
def test_prefixes_of_any_maps(groups, seed):
    rng = np.random.default_rng(seed)
    maps = rng.integers(0, 4, (6, 4))
    codes = np.array([c for g in groups for c in g])
    begins = np.array([k == 0 for g in groups for k in range(len(g))])
    want = []
    for g in groups:
        now = list(range(4))
        for c in g:
            now = [int(maps[c][s]) for s in now]
            want.append(now)
    assert am.compose_prefixes(maps[codes], begins).tolist() == want


def rows_of(sessions):
    return [(s, t, k) for s, keys in sessions.items() for t, k in enumerate(keys)]


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("batch", [3, 1000])
def test_keys_like_the_prompt(spark, parts, batch):
    """One session holds most keys and spans ranges and batches; one never quits; keys may be NULL or upper case."""
    rnd = random.Random(parts)
    sessions = {7: rnd.choices("yn10b234xYN ", k=2000), 1: list("nb"), 2: list("n3"), 3: list("nxq1"), 4: ["n", None, "4", "q", "y"], 5: list("0000000000"),
                None: list("n2y"), **{k: rnd.choices("yn10b234xq", k=20) for k in range(20, 60)}}
    df = spark.createDataFrame(rows_of(sessions), "session long, t int, key string").select(
        "session", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), F.col("t").alias("seq"), "key").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = fb.decode_keys(df)
        assert got.columns == ["session", "ts", "seq", "action", "level"]
        rows = {(r["session"], r["seq"]): (r["action"], r["level"]) for r in got.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {(s, t): said for s, keys in sessions.items() for t, said in enumerate(
        prompt([k.lower() if k else "none" for k in keys])) if said}
    assert rows == want


def test_empty(spark):
    df = spark.createDataFrame([], "session long, ts timestamp, seq long, key string")
    assert fb.decode_keys(df).count() == 0
