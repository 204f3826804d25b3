"""Epochs beside the same run in plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframes.plans import epochs as ep
from roadframes.plans.modelling import evaluate


def table(n=400, classes=3):
    rng = np.random.default_rng(3)
    y = rng.integers(0, classes, n)
    a, b = y * 1.5 + rng.normal(size=n), 40 - 9 * y + 12 * rng.normal(size=n)
    split = np.where(np.arange(n) % 10 < 7, "train", np.where(np.arange(n) % 10 < 9, "val", "test"))
    return [(int(k), s, int(c), float(u), float(v), 5.0) for k, (s, c, u, v) in enumerate(zip(split, y, a, b, strict=True))]


NAMES = "frame_id long, split string, label int, a double, b double, flat double"


def plain(rows, epochs, steps, rate, classes, seed):
    """Weights and figures of each epoch, with the mini-batches drawn by the same hash."""
    x = np.array([r[3:] for r in rows])
    y = np.array([r[2] for r in rows])
    split = np.array([r[1] for r in rows])
    train = split == "train"
    mean, scale = x[train].mean(0), x[train].std(0)
    x = np.column_stack([(x - mean) / np.where(scale == 0, 1, scale), np.ones(len(x))])
    w = np.zeros((classes, x.shape[1]))
    m, v, t, out = w.copy(), w.copy(), 0, []

    def forward(at):
        z = x[at] @ w.T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        return p, -np.log(p[np.arange(at.sum()), y[at]]).mean(), 100 * (z.argmax(1) == y[at]).mean()

    for epoch in range(epochs):
        number = np.array([int(hashlib.md5(f"{seed}|{epoch}|{r[0]}".encode()).hexdigest()[:4], 16) * steps // 65536 for r in rows])
        losses, hits = [], 0
        for batch in range(steps):
            at = train & (number == batch)
            if not at.any():
                continue
            p, loss, acc = forward(at)
            losses.append(loss)
            hits += acc * at.sum() / 100
            g = (p - np.eye(classes)[y[at]]).T @ x[at] / at.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        _, val_loss, val_acc = forward(split == "val")
        out.append((w, np.mean(losses), 100 * hits / train.sum(), val_loss, val_acc))
    return out


@pytest.mark.parametrize("steps", [1, 4, 15])
def test_epochs_like_numpy(spark, tmp_path, steps):
    rows = table(400 if steps < 15 else 20)  # 14 training rows leave some of 15 mini-batches empty
    df = spark.createDataFrame(rows, NAMES).repartition(5)
    options = dict(steps=steps, rate=0.1, classes=3, inputs=["a", "b", "flat"], seed=9)
    runs = ep.train_epochs(df, str(tmp_path), epochs=3, **options).orderBy("epoch").collect()
    want = plain(rows, 3, steps, 0.1, 3, 9)
    assert [r["epoch"] for r in runs] == [0, 1, 2]
    for r, (w, *figures) in zip(runs, want, strict=True):
        assert np.allclose([r["train_loss"], r["train_acc"], r["val_loss"], r["val_acc"]], figures, rtol=1e-9)
        assert np.allclose(ep.load_epoch(spark, str(tmp_path), r["epoch"]).weights, w, rtol=1e-7, atol=1e-10)


def test_a_stopped_run_goes_on(spark, tmp_path):
    df = spark.createDataFrame(table(), NAMES)
    options = dict(steps=3, classes=3, inputs=["a", "b"])
    ep.train_epochs(df, str(tmp_path / "whole"), epochs=4, **options)
    ep.train_epochs(df, str(tmp_path / "parts"), epochs=2, **options)
    # an epoch whose write was cut off leaves no rows and is done again
    (tmp_path / "parts" / "epoch_00002" / "_temporary").mkdir(parents=True)
    runs = ep.train_epochs(df, str(tmp_path / "parts"), epochs=4, **options)
    assert runs.count() == 4
    a, b = (ep.load_epoch(spark, str(tmp_path / name), 3) for name in ("whole", "parts"))
    assert a.step == b.step == 12 and np.allclose(a.weights, b.weights, rtol=1e-9) and np.allclose(a.second, b.second, rtol=1e-9)
    # an epoch goes on from the one before: four epochs are not one epoch from nothing
    assert not np.allclose(ep.load_epoch(spark, str(tmp_path / "whole"), 0).weights, a.weights, atol=0.05)
    with pytest.raises(ValueError, match="another configuration"):
        ep.train_epochs(df, str(tmp_path / "parts"), epochs=5, **{**options, "steps": 2})


def test_best_epoch_and_predictions(spark, tmp_path):
    rows = table()
    df = spark.createDataFrame(rows, NAMES)
    runs = ep.train_epochs(df, str(tmp_path), epochs=4, steps=2, classes=3, inputs=["a", "b", "flat"]).orderBy("epoch").collect()
    best = ep.load_epoch(spark, str(tmp_path))
    top = max(r["val_acc"] for r in runs)
    assert best.epoch == min(r["epoch"] for r in runs if r["val_acc"] == top)
    judged = {r["split"]: r for r in evaluate(best.predict(df)).collect()}
    assert abs(judged["val"]["accuracy"] - top) < 1e-9 and abs(judged["val"]["loss"] - best.figures["val_loss"]) < 1e-9
    assert judged["test"]["accuracy"] > 45  # chance: a third
    with pytest.raises(ValueError):
        ep.load_epoch(spark, str(tmp_path), 9)


def test_rows_that_cannot_be_learnt_from(spark, tmp_path):
    rows = table(60) + [(900, "train", 7, 1.0, 1.0, 1.0), (901, "train", None, 1.0, 1.0, 1.0), (902, "val", 1, None, 1.0, 1.0)]
    a = ep.train_epochs(spark.createDataFrame(rows, NAMES), str(tmp_path / "a"), epochs=1, classes=3, inputs=["a", "b"]).first()
    b = ep.train_epochs(spark.createDataFrame(rows[:60], NAMES), str(tmp_path / "b"), epochs=1, classes=3, inputs=["a", "b"]).first()
    assert np.allclose(a[2:], b[2:])
    none = spark.createDataFrame(rows, NAMES).where("split = 'test'")
    with pytest.raises(ValueError, match="no training rows"):
        ep.train_epochs(none, str(tmp_path / "c"), inputs=["a"])
    assert spark.createDataFrame(rows, NAMES).where(F.col("label") == 7).count() == 1
