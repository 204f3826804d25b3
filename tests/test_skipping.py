"""Files chosen by the sidecar: fewer of them, and never a row less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframes.operators.sampling import subset
from roadframes.sources import frames as store
from roadframes.sources import skipping as sk


@pytest.fixture
def stored(spark, frames, tmp_path):
    """Two layouts: ids in ranges, and ids dealt to files at random (where only the filters help)."""
    rng = np.random.default_rng(0)
    df = frames(*[(rng.integers(0, 256, 4), 2, 2, 1, "HWC") for _ in range(400)]).withColumn(
        "source", F.when(F.col("frame_id") % 2 == 0, "a b").otherwise("c%20"))
    paths = {}
    for name, dealt in (("ranges", df.repartitionByRange(8, "frame_id")), ("mixed", df.repartition(8, F.hash("frame_id")))):
        paths[name] = str(tmp_path / name)
        store.write_frames(dealt, paths[name])
        sk.index_frames(spark, paths[name])
    return paths


def ids_of(df):
    return sorted(r["frame_id"] for r in df.select("frame_id").collect())


@pytest.mark.parametrize("name", ["ranges", "mixed"])
def test_ids_from_few_files(spark, stored, name):
    path = stored[name]
    everything = store.scan_frames(spark, path)
    files = len(everything.inputFiles())
    got = sk.scan_ids(spark, path, [7, 7, 120, 121, 9999, -5, None])
    assert ids_of(got) == [7, 120, 121]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, everything.where("frame_id in (7, 120, 121)").collect()))
    assert len(got.inputFiles()) <= 4 < files / 3
    assert sk.scan_ids(spark, path, []).count() == 0 and sk.scan_ids(spark, path, [10**6]).count() == 0
    table = spark.createDataFrame([(3,), (None,), (3,), (399,)], "frame_id long")
    assert ids_of(sk.scan_ids(spark, path, table)) == [3, 399]


def test_samples_equal_those_of_the_frames(spark, stored):
    for path in stored.values():
        got = sk.scan_subset(spark, path, 3, seed=5)
        assert ids_of(got) == ids_of(subset(store.scan_frames(spark, path), 3, 5))
        assert len(got.inputFiles()) <= 3


def test_files_that_came_later_are_read(spark, stored, frames):
    path = stored["ranges"]
    more = frames(([1, 2, 3, 4], 2, 2, 1, "HWC")).withColumn("frame_id", F.lit(5000).cast("long"))
    store.write_frames(more, path, mode="append")
    assert ids_of(sk.scan_ids(spark, path, [5000, 6])) == [6, 5000]
    assert ids_of(sk.scan_subset(spark, path, 4, 1)) == ids_of(subset(store.scan_frames(spark, path), 4, 1))


def test_many_ids_and_no_index(spark, stored, frames, tmp_path, monkeypatch):
    monkeypatch.setattr(sk, "MOST_IDS", 20)
    path = stored["mixed"]
    assert ids_of(sk.scan_ids(spark, path, range(0, 400, 40))) == list(range(0, 400, 40))  # joined
    assert ids_of(sk.scan_ids(spark, path, range(50))) == list(range(50))  # beyond the bound
    plain = str(tmp_path / "plain")
    store.write_frames(store.scan_frames(spark, path), plain)
    assert ids_of(sk.scan_ids(spark, plain, [1, 2])) == [1, 2] and sk.scan_subset(spark, plain, 5).count() == 5


def test_null_ids_are_in_no_filter(spark, frames, tmp_path):
    df = frames(([1, 2, 3, 4], 2, 2, 1, "HWC"), ([1, 2, 3, 5], 2, 2, 1, "HWC")).withColumn("frame_id", F.when(F.col("frame_id") == 0, 0))
    store.write_frames(df, str(tmp_path / "n"))
    sk.index_frames(spark, str(tmp_path / "n"))
    assert ids_of(sk.scan_ids(spark, str(tmp_path / "n"), [0, 1])) == [0]
