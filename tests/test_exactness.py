"""Results at the edges: thresholds met to the last bit, missing and equal keys, values that are no numbers."""

import pytest
from pyspark.sql import functions as F

from roadframes.functions.scoring import traffic_level
from roadframes.operators import sampling, summary
from roadframes.sources import frames as stored


def test_level_a_hair_above(spark):
    df = spark.createDataFrame([(0.1,), (0.1 + 4e-10,), (0.3,), (0.30000000000000004,), (0.7000000001,)], "s double")
    steps = F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7)))
    assert [r[0] for r in df.select(traffic_level(F.col("s"), steps)).collect()] == [0, 1, 1, 2, 4]


def test_groups_keep_null_and_equal_keys(spark):
    rows = [(None, 0), (1, 1), (1, 2), (1, 3), (2, 4), (None, 5)] + [(i, i) for i in range(10, 60)]
    got = sampling.assign_group(spark.createDataFrame(rows, "frame_id long, v long"), 10).orderBy("rn").collect()
    assert sorted(r["v"] for r in got) == sorted(v for _, v in rows)
    assert [r["rn"] for r in got] == list(range(1, len(rows) + 1))
    assert [r["chunk_id"] for r in got] == [(r["rn"] - 1) // 10 for r in got]
    assert [r["frame_id"] for r in got][:6] == [None, None, 1, 1, 1, 2]


def test_chunks_move_pixels_once(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS frame_id", "array(id, id) AS pixels")
    plan = sampling.assign_group(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(_block" not in plan
    stored.write_chunks(df, str(tmp_path / "c"), 100)
    back = stored.read_chunks(spark, str(tmp_path / "c"))
    assert back.where("chunk_id = frame_id div 100 and pixels[0] = frame_id").count() == 1000


def test_negative_region(frames):
    from roadframes.operators.frames import crop, crop_in_bounds

    df = frames(([1.0] * 4, 2, 2, 1, "HW"))
    for call in (crop, crop_in_bounds):
        with pytest.raises(ValueError):
            call(df, -1, 0, 1, 1)
        with pytest.raises(ValueError):
            call(df, 0, -1, 1, 1)


def test_histogram_of_finite_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    got = summary.histogram(df, "v", 2).orderBy("bin").collect()
    assert [(r["bin_start"], r["bin_end"], r["rows"]) for r in got] == [(0.0, 1.0, 1), (1.0, 2.0, 2)]
