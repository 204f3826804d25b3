"""Blocks by count: one hot group within one hour is spread, and nothing changes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadframes.operators import feedback as fb
from roadframes.operators.running import ordered_blocks

EVENTS = "session bigint, ts timestamp_ntz, seq bigint, action string, level int"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def hot(spark):
    """Twenty thousand events of one scripted session within an hour, which never ends, beside some short ones."""
    rnd = random.Random(1)
    rows = []
    for k in range(20_000):
        action = "back" if k % 10 >= 5 else rnd.choice(["agree", "disagree"])
        rows.append((1, T0 + dt.timedelta(microseconds=170_000 * k), k, action, k % 5))
    rows += [(s, T0 + dt.timedelta(seconds=s * 7 + j), 10**6 + s * 20 + j, rnd.choice(["agree", "disagree", "back", "quit"]), j % 5)
             for s in range(2, 40) for j in range(15)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, as many ranges as a large table has
    yield spark.createDataFrame(rows, EVENTS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_hot_hour_is_spread(spark, hot):
    blocks = ordered_blocks(hot, ["session"], ["ts", "seq"])
    sizes = [r["count"] for r in blocks.groupBy("session", "_block").count().collect()]
    assert max(sizes) < 20_000 / 4 and sum(sizes) == hot.count()
    borders = blocks.where("session = 1").groupBy("_block").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("_block").collect()
    assert all(x["b"] < y["a"] for x, y in zip(borders, borders[1:]))


def test_answers_and_sessions_do_not_change(hot):
    want = sorted(fb.fold_reviews(hot).collect(), key=str)
    assert sorted(fb.fold_reviews(hot, block=None).collect(), key=str) == want and len(want) > 40
    seen = hot.select(F.col("session").alias("reviewer"), "ts", (F.col("action") == "agree").alias("was_correct"))
    want = sorted(fb.review_sessions(seen, "1 minute").collect())
    assert sorted(fb.review_sessions(seen, "1 minute", block=None).collect()) == want
