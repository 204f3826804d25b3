import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframes.functions.pixels import has_gaps
from roadframes.functions.scoring import level_name, traffic_level
from roadframes.operators import checks
from roadframes.operators import frames as fr
from roadframes.operators import metrics as mt
from roadframes.schemas import IMAGENET_MEAN, IMAGENET_STD


def px(df):
    return [list(r.pixels) if r.pixels is not None else None for r in df.orderBy("frame_id").collect()]


RNG = np.random.default_rng(0)
HWC = RNG.integers(0, 256, (4, 5, 3))
CHW = HWC.transpose(2, 0, 1)


def test_layout_round_trip(frames):
    df = frames((CHW.ravel(), 4, 5, 3, "CHW"), (HWC.ravel(), 4, 5, 3, "HWC"))
    assert px(fr.to_hwc(df)) == [HWC.ravel().tolist()] * 2
    assert px(fr.to_chw(df)) == [CHW.ravel().tolist()] * 2
    assert px(fr.to_chw(fr.to_hwc(df))) == [CHW.ravel().tolist()] * 2


@pytest.mark.parametrize("layout,data", [("HWC", HWC), ("CHW", CHW)])
def test_normalise_and_back(frames, layout, data):
    df = frames((data.ravel(), 4, 5, 3, layout))
    there = fr.normalise(df)
    axis = (1, 1, 3) if layout == "HWC" else (3, 1, 1)
    want = (data / 255 - np.reshape(IMAGENET_MEAN, axis)) / np.reshape(IMAGENET_STD, axis)
    assert np.allclose(px(there)[0], want.ravel(), atol=1e-6)
    assert np.allclose(px(fr.denormalise(there))[0], data.ravel() / 255, atol=1e-6)


def test_denormalise_clamps(frames):
    df = frames(([9.0] * 3 + [-9.0] * 3, 1, 2, 3, "HWC"))
    assert px(fr.denormalise(df)) == [[1.0] * 3 + [0.0] * 3]


def test_to_tensor_is_resize_normalise_reorder(frames):
    df = frames((HWC.ravel(), 4, 5, 3, "HWC"), (None, 4, 5, 3, "HWC"))
    steps = fr.to_chw(fr.normalise(fr.resize(df, 6)))
    got = fr.to_tensor(df, 6)
    assert np.allclose(px(got)[0], px(steps)[0], atol=1e-5) and px(got)[1] is None
    row = got.first()
    assert (row.height, row.width, row.channels, row.layout) == (6, 6, 3, "CHW")


def test_scoring_tensors_is_denormalise_then_score(frames):
    df = fr.normalise(frames((CHW.ravel(), 4, 5, 3, "CHW"), (HWC.ravel(), 4, 5, 3, "HWC")))
    a = mt.frame_counts(fr.denormalise(df), by_channel=True).orderBy("frame_id").collect()
    b = mt.frame_counts(df, normal=(IMAGENET_MEAN, IMAGENET_STD), by_channel=True).orderBy("frame_id").collect()
    assert a == b


def test_crop_and_bounds(frames):
    df = frames((HWC.ravel(), 4, 5, 3, "HWC"), (HWC[:3].ravel(), 3, 5, 3, "HWC"))
    kept, rejects = fr.crop_in_bounds(df, 1, 2, 4, 2)
    assert [r.frame_id for r in kept.collect()] == [0] and [r.frame_id for r in rejects.collect()] == [1]
    assert px(fr.crop(kept, 1, 2, 4, 2)) == [HWC[2:4, 1:5].ravel().tolist()]
    assert px(fr.crop(rejects, 1, 2, 4, 2)) == [None]
    first = frames((CHW.ravel(), 4, 5, 3, "CHW"))
    assert px(fr.crop(first, 1, 2, 4, 2)) == [CHW[:, 2:4, 1:5].ravel().tolist()]
    with pytest.raises(ValueError):
        fr.crop(df, 0, 0, 0, 3)


def test_minmax_of_a_constant_is_zero(frames):
    df = frames(([5, 5, 5, 5], 2, 2, 1, "HWC"), ([0, 5, 10, 5], 2, 2, 1, "HWC"))
    assert px(fr.minmax_scale(df)) == [[0, 0, 0, 0], [0, 0.5, 1, 0.5]]


def test_to_uint8_branches(frames):
    df = frames(([0, 1, 1, 0], 2, 2, 1, "HWC"), ([0.999, 0.5, -0.25, 0], 2, 2, 1, "HWC"), ([1.9, 300, -3.7, 255], 2, 2, 1, "HWC"))
    assert px(fr.to_uint8(df)) == [[0, 255, 255, 0], [254, 127, 0, 0], [1, 255, 0, 255]]
    assert px(fr.to_uint8(df, "wrap")) == [[0, 255, 255, 0], [254, 127, 193, 0], [1, 44, 253, 255]]
    with pytest.raises(ValueError):
        fr.to_uint8(df, "other")


def test_gray_and_rgb(frames):
    df = frames(([255, 0, 0, 0, 255, 0], 1, 2, 3, "HWC"), ([7, 9], 1, 2, 1, "HWC"), ([1, 2, 3, 4, 5, 6, 7, 8], 1, 2, 4, "HWC"))
    assert px(fr.gray(df))[:2] == [[76, 150], [7, 9]]
    assert px(fr.gray_to_rgb(df)) == [[255, 0, 0, 0, 255, 0], [7, 7, 7, 9, 9, 9], [1, 2, 3, 5, 6, 7]]


def test_unbatch(frames):
    df = frames((range(12), 2, 2, 1, "HWC")).withColumn("shape", F.array(*map(F.lit, (1, 3, 2, 2))))
    row = fr.unbatch(df).first()
    assert list(row.pixels) == [0, 1, 2, 3] and list(row["shape"]) == [2, 2]


def test_rejects_and_defaults(spark, frames):
    df = frames(([1, 2], 1, 2, 1, "HWC"), (None, 1, 2, 1, "HWC"), ([1], 1, 2, 1, "HWC"), ([None, 1], 1, 2, 1, "HWC"))
    kept, rejects = fr.split_rejects(df)
    assert kept.count() == 1
    assert [r.reason for r in rejects.orderBy("frame_id").collect()] == ["no pixels", "impossible shape", "value is not a number"]
    holes = spark.createDataFrame([(None,) * 5], "density double, congestion double, flow_rate double, traffic_level int, valid boolean")
    assert tuple(fr.fill_defaults(holes).first()) == (0.0, 0.0, 0.0, 0, False)


def test_labels(frames):
    df = frames(([1], 1, 1, 1, "HWC"))
    assert fr.label_by_source(df, {"s": 1, "t": 0}).first().label == 1
    assert fr.label_by_source(df, {"t": 0}).first().label is None
    assert fr.constant_label(df, 3).first().label == 3


def test_level_of_unsorted_and_short_thresholds(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.3,), (0.95,)], "s double")
    def levels(*t):
        return [r[0] for r in df.select(traffic_level(F.col("s"), F.array(*map(F.lit, t)))).collect()]
    assert levels(0.1, 0.3, 0.5, 0.7) == [0, 1, 1, 4]
    assert levels(0.9, 0.2, 0.99) == [0, 2, 2, 2]
    assert [r[0] for r in df.select(traffic_level(F.col("s"), F.array().cast("array<double>"))).collect()] == [0] * 4
    assert df.select(level_name(F.lit(4))).first()[0] == "Severe congestion"


def test_level_rises_with_the_score(spark):
    df = spark.range(200).select((F.col("id") / 100).alias("s"))
    rows = df.select("s", traffic_level(F.col("s"), F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7)))).alias("l")).orderBy("s").collect()
    assert all(a.l <= b.l for a, b in zip(rows, rows[1:]))


def test_params(spark):
    old = mt.default_params(spark)
    new = mt.update_params(old, density_weight=0.5, thresholds=[0.2, 0.4, 0.6]).first()
    assert tuple(new)[:3] == (0.5, 1.0, 50) and list(new.thresholds) == [0.2, 0.4, 0.6]
    part = spark.createDataFrame([(None, 2.0, None, None)], old.schema)
    merged = mt.merge_params(old, part).first()
    assert tuple(merged)[:3] == (1.0, 2.0, 50) and len(merged.thresholds) == 4


def test_rescore_equals_scoring_anew(spark, frames):
    df = frames(*[(RNG.integers(0, 256, 64), 8, 8, 1, "HWC") for _ in range(30)], (None, 8, 8, 1, "HWC"))
    params = dict(density_weight=0.3, congestion_weight=0.4, thresholds=[0.5, 0.2, 0.3])
    again = mt.rescore(mt.analyze(df), mt.default_params(spark, **params))
    anew = mt.analyze(df, **params)
    cols = ["frame_id", "traffic_score", "traffic_level"]
    assert sorted(again.select(*cols).collect()) == sorted(anew.select(*cols).collect())


def test_checks(frames):
    df = frames((HWC.ravel(), 4, 5, 3, "HWC"), (HWC.ravel()[:-1], 4, 5, 3, "HWC"), ([float("nan")] * 60, 4, 5, 3, "HWC"))
    found = {r.name: r.passed for r in checks.verify_frames(df, (3, 4, 5)).collect()}
    assert found == {"tensors": True, "size": True, "shape": False, "range": False}
    raw = df.withColumnRenamed("pixels", "image_url")
    assert {r.name: r.passed for r in checks.verify_frames(raw).collect()} == {"tensors": False, "size": True}
    empty = {r.name: r.passed for r in checks.verify_frames(df.limit(0)).collect()}
    assert empty["size"] is False


def test_verify_splits_finds_faults(spark):
    whole = spark.range(4).withColumnRenamed("id", "frame_id")
    split = spark.createDataFrame([(0,), (1,), (1,), (9,)], "frame_id long")
    row = checks.verify_splits(split, whole).first()
    assert not row.passed and row.detail == "1 repeated, 2 missing, 1 unknown"


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_gaps_in_values(spark, kind):
    nan = float("nan")
    rows = [([1.0, 2.0],), ([1.0, None],), ([nan, 1.0],), ([None, nan],), ([None],), ([float("inf")],), ([],), (None,)]
    got = spark.createDataFrame(rows, f"px {kind}").select(has_gaps(F.col("px"))).collect()
    assert [r[0] for r in got] == [False, True, True, True, True, False, False, False]
