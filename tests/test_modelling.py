import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from roadframes.operators import metrics as mt
from roadframes.operators.frames import label_by_source
from roadframes.operators.sampling import split_by_source
from roadframes.plans import modelling as md
from roadframes.schemas import FRAMES


def make(spark, n=120):
    """Two sources that differ in brightness."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        dark = i % 2 == 0
        px = rng.integers(0, 120, 192) if dark else rng.integers(100, 256, 192)
        rows.append((i, "night" if dark else "day", 8, 8, 3, "HWC", [float(v) for v in px], 0))
    return spark.createDataFrame(rows, FRAMES)


def test_source_classifier_learns_and_is_stored(spark, tmp_path):
    features = split_by_source(label_by_source(md.frame_features(make(spark), 100), {"night": 0, "day": 1})).cache()
    models, runs = md.train_runs(features, iterations=(1, 20))
    best = md.save_best(models, runs, str(tmp_path))
    scored = md.predict(PipelineModel.load(best), features)
    judged = {r.split: r for r in md.evaluate(scored).collect()}
    assert judged["test"].accuracy > 95 and judged["test"].rows == 18
    assert {"train_loss", "train_acc", "val_loss", "val_acc"} <= set(runs.columns) and runs.count() == 2


def test_heads_and_levels(spark):
    metrics = mt.analyze(make(spark, 60), 100)
    model = md.fit_level_classifier(metrics, hidden=8, max_iter=20)
    out = md.predict(model, metrics)
    assert out.count() == 60 and len(out.first().probability) == 5
    features = md.frame_features(make(spark, 60), 100)
    for name, head in md.fit_parameter_heads(features).items():
        errors = md.predict(head, features).agg(F.avg(F.abs(F.col(f"{name}_predicted") - F.col(name)))).first()
        assert errors[0] < 0.2


def test_features_by_hand(spark, frames):
    row = md.frame_features(frames(([0, 10, 20, 2, 30, 60], 1, 2, 3, "HWC")), 100).first()
    assert (row.r_mean, row.g_mean, row.b_mean) == (1.0, 20.0, 40.0)
    assert (row.r_std, row.g_std, row.b_std) == (1.0, 10.0, 20.0)
