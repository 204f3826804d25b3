import numpy as np
from pyspark.sql import functions as F

from roadframes.operators import metrics as mt
from roadframes.plans import jobs
from roadframes.sources import feedback as fs
from roadframes.sources import images as im
from roadframes.sources.frames import scan_frames


def test_from_images_to_learnt_parameters(spark, frames, tmp_path):
    rng = np.random.default_rng(0)
    df = frames(*[(rng.integers(0, 256, 12 * 10 * 3), 12, 10, 3, "HWC") for _ in range(20)], ([1] * 75, 5, 5, 3, "HWC"))
    name = F.format_string("CAM_%d_20240101_0000%02d.png", F.col("frame_id") % 2, F.col("frame_id"))
    im.write_image_files(df.withColumn("name", name), str(tmp_path / "images"))
    (tmp_path / "images" / "junk.png").write_bytes(b"x")

    found, rejects = jobs.prepare_dataset(spark, str(tmp_path / "images"), str(tmp_path / "frames"), 8, (1, 2, 8, 9))
    assert all(r.passed for r in found.collect())
    assert sorted(r.reason for r in rejects.collect()) == ["cannot decode image", "region exceeds image"]
    stored = scan_frames(spark, str(tmp_path / "frames"))
    assert stored.select("frame_id").distinct().count() == 20
    assert {r.source for r in stored.select("source").distinct().collect()} == {"CAM_0", "CAM_1"}

    metrics = jobs.score_dataset(spark, str(tmp_path / "frames"), str(tmp_path / "metrics"), edge_threshold=100)
    assert metrics.count() == metrics.where("valid").count() == 20 and "pixels" not in metrics.columns
    some = jobs.score_dataset(spark, str(tmp_path / "frames"), str(tmp_path / "some"), sample=7)
    assert some.count() == 7

    parts = jobs.summaries(metrics)
    assert sum(r.rows for r in parts["distributions"].where("metric = 'density'").collect()) == 20
    assert sum(r.rows for r in parts["levels"].collect()) == 20 and parts["samples"].count() == 12

    entries = metrics.select(
        F.lit("s").alias("session"), F.lit("20240101_000000").alias("timestamp"), F.lit(1.0).alias("session_duration"),
        F.col("frame_id").alias("image_index"), F.col("traffic_level").cast("double").alias("model_prediction"),
        F.lit(2.0).alias("user_correction"), (F.col("traffic_level") == 2).alias("was_correct"), "density", "congestion")
    fs.write_feedback(entries, str(tmp_path / "feedback"), one_file_each=True)
    params, again = jobs.learn_from_feedback(spark, metrics, str(tmp_path / "feedback"))
    want = mt.rescore(metrics, params)
    assert params.count() == 1 and sorted(again.collect()) == sorted(want.collect())
