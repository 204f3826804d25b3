import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadframes.operators import feedback as fb
from roadframes.operators import metrics as mt
from roadframes.operators.frames import to_rgb
from roadframes.sources import images as im
from roadframes.streaming import captures as sc
from roadframes.streaming import learning as sl
from roadframes.streaming import reviews as sr
from test_feedback import REVIEW, make_events, reviews

EVENTS = "session bigint, ts timestamp_ntz, seq bigint, action string, level int"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """A folder to which rows arrive file by file, and a stream worked through each time."""

    def __init__(self, spark, tmp_path, schema, build, one_by_one=False):
        self.spark, self.dir, self.schema, self.build = spark, tmp_path, schema, build
        self.options = {"maxFilesPerTrigger": 1} if one_by_one else {}

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.dir / "in"))

    def run(self):
        stream = self.build(self.spark.readStream.schema(self.schema).options(**self.options).parquet(str(self.dir / "in")))
        with sr.stream_settings(self.spark):
            sc.run_to_table(stream, str(self.dir / "out"), str(self.dir / "checkpoint"))
        return self.spark.read.schema(stream.schema).parquet(str(self.dir / "out"))


def test_slots_close_with_the_watermark_and_late_rows_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path, "camera string, captured_at timestamp_ntz", sc.capture_slots)
    feed.add([("a", at(1)), ("a", at(2)), ("b", at(20))])
    feed.run()
    feed.add([("a", at(61))])
    feed.run()
    feed.add([("a", at(3)), ("a", at(200))])  # at(3) is long past
    got = {(r.camera, str(r.slot)[11:16]): r.captures for r in feed.run().collect()}
    assert got == {("a", "00:00"): 2, ("b", "00:15"): 1, ("a", "01:00"): 1}


def test_sessions_equal_the_batch_on_closed_ones(spark, tmp_path):
    rows, _ = make_events(21, sessions=5, per=30)
    rows = sorted(((s, t, a == "agree") for s, t, _, a, _ in rows), key=lambda r: r[1])
    feed = Feed(spark, tmp_path, "reviewer bigint, ts timestamp_ntz, was_correct boolean",
                lambda df: sr.review_sessions_stream(df, "2 hours", "1 hour"), one_by_one=True)
    for part in np.array_split(np.arange(len(rows)), 4):
        feed.add([rows[i] for i in part])
    got = sorted(tuple(r) for r in feed.run().collect())
    batch = fb.review_sessions(feed.spark.createDataFrame(rows, feed.schema))
    end = max(t for _, t, _ in rows) - dt.timedelta(hours=1)
    want = sorted(tuple(r) for r in batch.collect() if r.ends_at <= end)
    assert got == want and len(want) > 2


@pytest.mark.parametrize("small", [1024, 3])
@pytest.mark.parametrize("seed", [31, 32])
def test_fold_stream_equals_the_batch(spark, tmp_path, monkeypatch, seed, small):
    monkeypatch.setattr(sr.FoldReviews, "SMALL", small)
    rows, _ = make_events(seed, sessions=6, per=25)
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    feed = Feed(spark, tmp_path, EVENTS, sr.fold_reviews_stream, one_by_one=True)
    mixed = [rows[i] for part in np.array_split(np.arange(len(rows)), 3) for i in np.random.default_rng(seed).permutation(part)]
    for part in np.array_split(np.arange(len(mixed)), 3):
        feed.add([mixed[i] for i in part])
        feed.run()  # stops, and starts again from its checkpoint
    feed.add([(999, at(10_000_000), 10**6, "quit", 0)])  # lets the watermark pass all events
    changes = feed.run()
    assert changes.where("op = 'late'").count() == 0
    got = sorted(sr.standing_answers(changes).where("session <> 999").collect())
    want = sorted(fb.fold_reviews(spark.createDataFrame(rows, EVENTS)).collect())
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_late_review_events_are_reported(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS, sr.fold_reviews_stream)
    feed.add([(1, at(0), 0, "agree", 0), (2, at(600), 1, "agree", 0)])
    feed.run()
    feed.add([(1, at(1), 2, "back", 0), (2, at(1200), 3, "quit", 0)])
    changes = feed.run()
    assert [tuple(r)[:4] for r in sr.standing_answers(changes).where("session = 1").collect()] == [(1, 0, True, None)]
    late = changes.where("op = 'late'").collect()
    assert len(late) in (0, 1)  # the engine itself may drop the row before it reaches the state


def test_image_stream_equals_the_batch(spark, frames, tmp_path):
    rng = np.random.default_rng(0)
    df = frames(*[(rng.integers(0, 256, 64), 8, 8, 1, "HWC") for _ in range(6)]).withColumn("name", F.format_string("%d.png", "frame_id"))
    path = tmp_path / "images"
    im.write_image_files(df, str(path))
    (path / "junk.png").write_bytes(b"x")
    scores = sc.score_stream(sc.stream_captures(spark, str(path), max_files=2), 100)
    sc.run_to_table(scores, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = mt.analyze(to_rgb(im.scan_images(spark, str(path))), 100)
    cols = ["origin", "valid", "edge_px", "traffic_level"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert got.where("valid").count() == 6


def test_online_params_equal_the_batch_and_survive_a_repeat(spark, tmp_path):
    df = reviews(spark, (4, 2, 0.5, 1.0), (3, 2, 0.7, 0.2), (0, 4, 0.1, 0.1), (1, 1, 0.2, 0.2))
    for i in range(4):
        df.where(F.col("frame_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sl.online_params(stream, str(tmp_path / "sink"), str(tmp_path / "checkpoint")).awaitTermination()
    want = [round(x, 9) for x in fb.learn_params(df).first().thresholds]
    assert [round(x, 9) for x in sl.latest_params(spark, str(tmp_path / "sink")).first().thresholds] == want
    # all batches once more, as after a lost checkpoint: the sums are replaced, not added
    sl.online_params(stream, str(tmp_path / "sink"), str(tmp_path / "checkpoint2")).awaitTermination()
    assert [round(x, 9) for x in sl.latest_params(spark, str(tmp_path / "sink")).first().thresholds] == want


class _Handle:
    """State of one session in memory; ``calls`` counts what would go to the JVM and back."""

    def __init__(self):
        self.calls = 0

    def getValueState(self, name, schema):
        return _Value(self)

    def getMapState(self, name, *schema):
        return _Value(self)

    def registerTimer(self, at):
        self.calls += 1


class _Value:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def __getattr__(self, name):
        if name not in ("get", "update", "clear", "exists"):
            raise AttributeError(name)

        def call(*value):
            self.handle.calls += 1
            if name == "get":
                return self.value
            if name == "exists":
                return self.value is not None
            self.value = value[0] if name == "update" else None

        return call


class _Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_standing_session_makes_one_frame_and_few_state_calls(monkeypatch):
    """A session costs one frame when its events come and none when their minutes pass."""
    fold, handle = sr.StandingReviews(12), _Handle()
    fold.init(handle)
    start = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({
        "ts": [start + pd.Timedelta(minutes=k) for k in range(5)], "seq": range(5),
        "action": ["agree", "disagree", "agree", "back", "disagree"], "level": [0, 3, 1, 0, 4]})
    told = list(fold.handleInputRows((7,), iter([rows]), _Times(0)))
    assert len(told) == 1 and handle.calls <= 8
    got = told[0].astype({"answered_at": "datetime64[us]"})
    assert got["image_index"].tolist() == [0, 1, 2] and got["op"].tolist() == ["answer"] * 3
    assert got["was_correct"].tolist() == [True, False, False] and got["corrected_level"].tolist() == [pd.NA, 3, 4]
    assert got["answered_at"].tolist() == [start, start + pd.Timedelta(minutes=1), start + pd.Timedelta(minutes=4)]

    def no_frame(*_):
        raise AssertionError("a frame was made of changes that nobody reads")

    handle.calls = 0
    monkeypatch.setattr(sr.StandingReviews, "_changes", staticmethod(no_frame))
    passed = int(start.timestamp() * 1000) + 3 * 60_000
    assert list(fold.handleExpiredTimer((7,), _Times(passed), None)) == []
    assert handle.calls <= 7
    assert [a[0] for a in fold._shown()[2]] == [True, False, True] and fold.pos == 3

    more = pd.DataFrame({"ts": [start + pd.Timedelta(minutes=3, seconds=9)], "seq": [9], "action": ["back"], "level": [0]})
    (now,) = fold.handleInputRows((7,), iter([more]), _Times(passed))
    assert now["op"].tolist() == ["answer", "answer", "delete"] and now["step"].unique().tolist() == [2]
    assert now["was_correct"].tolist()[:2] == [True, False] and now["answered_at"].isna().tolist() == [False, False, True]
