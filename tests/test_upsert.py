"""Streams that also give what is open at the end, and state that ends."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframes.operators import feedback as fb
from roadframes.streaming import captures as sc
from roadframes.streaming import reviews as sr
from roadframes.streaming import upsert as up
from test_feedback import make_events

T0 = dt.datetime(2024, 1, 1)
EVENTS = "session bigint, ts timestamp_ntz, seq bigint, action string, level int"
SESSIONS = "reviewer bigint, ts timestamp_ntz, was_correct boolean"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """Rows arrive file by file; each run works through what is new into the keyed sink."""

    def __init__(self, spark, folder, schema, build, keys, order=None, compact_every=3):
        self.spark, self.dir, self.schema, self.build = spark, folder, schema, build
        self.keys, self.order, self.every = keys, order, compact_every

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.dir / "in"))

    def run(self, checkpoint="checkpoint"):
        stream = self.build(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.dir / "in")))
        with sr.stream_settings(self.spark):
            up.upsert_to_table(stream, str(self.dir / "out"), str(self.dir / checkpoint), self.keys, self.order, compact_every=self.every)
        return up.read_latest(self.spark, str(self.dir / "out"), stream, self.keys, self.order)


def test_slots_are_replaced_and_folded_into_a_base(spark, tmp_path):
    feed = Feed(spark, tmp_path, "camera string, captured_at timestamp_ntz", lambda df: sc.capture_slots(df, late="1 day"), ["camera", "slot"])
    for k in range(5):
        feed.add([("a", at(1 + k)), ("b", at(20 * k))])
        got = {(r.camera, r.slot): r.captures for r in feed.run().collect()}
        assert got[("a", T0)] == k + 1 and sum(got.values()) == 2 * (k + 1)
    assert list(up.numbered_folders(spark, str(tmp_path / "out/base")))
    assert len(up.numbered_folders(spark, str(tmp_path / "out/changes"))) <= 4


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path, "camera string, captured_at timestamp_ntz", lambda df: sc.capture_slots(df, late="1 day"), ["camera", "slot"], compact_every=100)
    for k in range(3):
        feed.add([("a", at(k)), ("b", at(40 * k))])
    first = sorted(feed.run().collect())
    assert sorted(feed.run("another checkpoint").collect()) == first  # all batches once more


def test_a_write_that_was_cut_off_is_not_read(spark, tmp_path):
    feed = Feed(spark, tmp_path, "camera string, captured_at timestamp_ntz", lambda df: sc.capture_slots(df, late="1 day"), ["camera", "slot"], compact_every=100)
    feed.add([("a", at(0))])
    want = feed.run().collect()
    for name in ("changes/batch_000000000099", "base/upto_000000000099"):
        (tmp_path / "out" / name).mkdir(parents=True)  # no _SUCCESS
    assert feed.run().collect() == want


def test_sessions_open_and_closed(spark, tmp_path, seed=3):
    """Shuffled inside a batch, so later events join sessions that were told apart before."""
    rows, _ = make_events(seed, sessions=5, per=30)
    rows = sorted(((s, t, a == "agree") for s, t, _, a, _ in rows), key=lambda r: r[1])
    feed = Feed(spark, tmp_path, SESSIONS, lambda df: sr.review_sessions_now(df, "2 hours", "100 days"), ["reviewer", "started_at"], "step")
    for part in np.array_split(np.random.default_rng(seed).permutation(len(rows)), 3):
        feed.add([rows[i] for i in part])
        got = feed.run()
    want = fb.review_sessions(spark.createDataFrame(rows, SESSIONS))
    names = ["reviewer", "started_at", "ends_at", "total", "correct"]
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(tuple(r) for r in want.select(names).collect())


def test_closed_sessions_leave_no_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, SESSIONS, lambda df: sr.review_sessions_now(df, "2 hours", "1 hour"), ["reviewer", "started_at"], "step")
    feed.add([(k, at(k), True) for k in range(20)])
    feed.run()
    feed.add([(99, at(10_000), True)])
    feed.run()
    feed.add([(99, at(10_001), True)])
    assert feed.run().count() == 21
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "checkpoint"))
    assert {r[0] for r in state.select("key.reviewer").collect()} == {99}


@pytest.mark.parametrize("small,seed", [(1024, 31), (2, 32)])
def test_standing_answers_after_every_batch(spark, tmp_path, monkeypatch, seed, small):
    """What stands after each batch equals the batch fold of all rows so far, waiting minutes included."""
    monkeypatch.setattr(sr.FoldReviews, "SMALL", small)
    rows, _ = make_events(seed, sessions=6, per=25)
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    feed = Feed(spark, tmp_path, EVENTS, lambda df: sr.standing_reviews_stream(df, forget=None), ["session", "image_index"], "step")
    names = ["session", "image_index", "was_correct", "corrected_level"]
    so_far = []
    for part in np.array_split(np.arange(len(rows)), 3):
        mixed = np.random.default_rng(seed).permutation(part)
        feed.add([rows[i] for i in mixed])
        so_far += [rows[i] for i in part]
        got = sorted(tuple(r) for r in feed.run().select(names).collect())
        want = fb.fold_reviews(spark.createDataFrame(so_far, EVENTS))
        assert got == sorted(tuple(r) for r in want.select(names).collect())


@pytest.mark.parametrize("build", [sr.fold_reviews_stream, sr.standing_reviews_stream])
def test_an_ended_session_is_forgotten(spark, tmp_path, build):
    """No state row a day of watermark after the end; an event after the end puts that off."""
    feed = Feed(spark, tmp_path, EVENTS, lambda df: build(df, forget="1 day"), ["session"], "step")

    def walks():
        state = spark.read.format("statestore").option("stateVarName", "walk").load(str(tmp_path / "checkpoint"))
        return {r[0] for r in state.select("key.session").collect()}

    feed.add([(1, at(0), 0, "agree", 0), (1, at(1), 1, "quit", 0), (2, at(0), 2, "quit", 0), (3, at(0), 3, "agree", 0)])
    feed.run()
    feed.add([(9, at(600), 4, "agree", 0)])
    feed.run()
    feed.add([(2, at(1000), 5, "agree", 0), (9, at(1001), 6, "agree", 0)])
    feed.run()
    assert walks() == {1, 2, 3, 9}
    feed.add([(9, at(24 * 60 + 30), 7, "agree", 0)])
    feed.run()
    assert walks() == {2, 3, 9}
    feed.add([(9, at(3 * 24 * 60), 8, "agree", 0)])
    feed.run()
    assert walks() == {3, 9}


def test_spans():
    from pyspark.sql import SparkSession

    df = SparkSession.active().range(1)
    assert sr._milliseconds(df, "2 hours") == 7_200_000 and sr._milliseconds(df, None) is None
    assert df.select(F.lit(1)).count() == 1
