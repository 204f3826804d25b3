"""Training in epochs of one run: mini-batch gradient steps whose state goes on from epoch to epoch.

The model is a linear softmax over standardised frame features; it stands where a deep network is trained
elsewhere, and the loop is the same one: shuffled mini-batches, Adam, a validation after every epoch, and the state of every epoch kept.

A step is one Spark job. Tasks add up the gradients of their rows of the mini-batch, and the partial
sums are added in a shuffle with a key for each weight, so the driver sees as many numbers as there are
weights, whatever the data. A mini-batch is a share of the rows, drawn anew for each epoch by a hash of seed,
epoch and key: nothing is sorted or moved for it. After an epoch the weights, the optimizer's moments and the
epoch's figures are written as one Parquet row to a folder of their own, so a run that was stopped goes on
after its last whole epoch and gives what it would have given.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.operators.running import seeded_hash
from roadframes.operators.summary import argmax_prediction
from roadframes.plans.modelling import FEATURES
from roadframes.session import materialise

cloudpickle.register_pickle_by_value(sys.modules["roadframes"])

STATE = ("epoch int, step int, weights array<double>, first array<double>, second array<double>, inputs array<string>, mean array<double>, "
         "scale array<double>, classes int, steps int, rate double, seed int, "
         "train_loss double, train_acc double, val_loss double, val_acc double")
# Adam's decay rates and its guard against division by zero, as published.
DECAY_FIRST, DECAY_SECOND, GUARD = 0.9, 0.999, 1e-8
#: Hex digits of the hash that deals rows to mini-batches.
DIGITS = 4


@dataclass
class Checkpoint:
    """What an epoch leaves behind; ``weights`` and moments are (classes, inputs + 1), the last column for the constant."""

    epoch: int
    step: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    inputs: list[str]
    mean: np.ndarray
    scale: np.ndarray
    figures: dict[str, float | None]

    def probabilities(self) -> Column:
        """Class probabilities from the input columns, as native expressions."""
        values = [(F.col(c) - m) / s for c, m, s in zip(self.inputs, self.mean.tolist(), self.scale.tolist(), strict=True)]
        logits = []
        for w in self.weights.tolist():
            total = F.lit(w[-1])
            for value, weight in zip(values, w, strict=False):
                total = total + value * weight
            logits.append(total)
        top = F.greatest(*logits)
        parts = [F.exp(x - top) for x in logits]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return F.array(*(part / total for part in parts))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction`` (of equal probabilities the smallest class)."""
        return df.withColumn("probability", self.probabilities()).withColumn(
            "prediction", argmax_prediction(F.col("probability")).cast("double"))


def adam(c: Checkpoint, gradient: np.ndarray, rate: float) -> Checkpoint:
    """The state after one step."""
    step = c.step + 1
    first = DECAY_FIRST * c.first + (1 - DECAY_FIRST) * gradient
    second = DECAY_SECOND * c.second + (1 - DECAY_SECOND) * gradient**2
    move = rate * (first / (1 - DECAY_FIRST**step)) / (np.sqrt(second / (1 - DECAY_SECOND**step)) + GUARD)
    return Checkpoint(c.epoch, step, c.weights - move, first, second, c.inputs, c.mean, c.scale, c.figures)


def batch_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed gradient (one number for each weight), loss, hits and rows of some rows."""
    logits = x @ weights.T
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    total = p.sum(axis=1, keepdims=True)
    p /= total
    rows = np.arange(len(y))
    loss = np.log(total[:, 0]) - logits[rows, y]
    hits = int((logits.argmax(axis=1) == y).sum())
    p[rows, y] -= 1
    return np.concatenate([(p.T @ x).ravel(), [loss.sum(), hits, len(y)]])


def _sums(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """``batch_sums`` over all rows: in each task first, then by key."""
    size = weights.size + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                total += batch_sums(x, batch.column("y").to_numpy(), weights)
        if total[-1]:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size), pa.int32()), "value": pa.array(total)})

    parts = rows.select("x", "y").mapInArrow(run, "at int, value double")
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def batch_number(key: str, seed: int, epoch: int, steps: int) -> Column:
    """The mini-batch of a row in an epoch."""
    digest = seeded_hash(F.concat_ws("|", F.lit(str(epoch)), F.col(key).cast("string")), seed)
    return F.floor(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") * steps / 16**DIGITS)


def epochs_of(spark: SparkSession, folder: str) -> DataFrame:
    """The stored states, one row for each epoch; none yet gives an empty table."""
    try:
        return spark.read.schema(STATE).parquet(f"{folder}/epoch_*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def _checkpoint(row) -> Checkpoint:
    arrays = (np.array(row[c]).reshape(row["classes"], -1) for c in ("weights", "first", "second"))
    figures = {c: row[c] for c in ("train_loss", "train_acc", "val_loss", "val_acc")}
    return Checkpoint(row["epoch"], row["step"], *arrays, row["inputs"], np.array(row["mean"]), np.array(row["scale"]), figures)


def load_epoch(spark: SparkSession, folder: str, epoch: int | None = None) -> Checkpoint:
    """A stored epoch; without a number the first of the best validation accuracy, among values above 0."""
    rows = epochs_of(spark, folder)
    if epoch is None:
        rows = rows.where("val_acc > 0").orderBy(F.desc("val_acc"), "epoch")
    else:
        rows = rows.where(F.col("epoch") == epoch)
    row = rows.first()
    if row is None:
        raise ValueError(f"{folder} holds no such epoch")
    return _checkpoint(row)


def train_epochs(
    features: DataFrame, folder: str, epochs: int = 5, steps: int = 4, rate: float = 0.05, classes: int = 2,
    inputs: Sequence[str] = FEATURES, label: str = "label", key: str = "frame_id", seed: int = 0, run: str = "source",
) -> DataFrame:
    """Train up to ``epochs`` epochs of ``steps`` mini-batches, going on after the last one in ``folder``.

    ``features`` has a ``split`` column (train, val). The run table has one row for each epoch: the mean loss of its mini-batches
    and the accuracy, both as each batch met the weights, and loss and accuracy on the validation rows afterwards. Rows with a NULL
    among the inputs or a label that is no class are left out. A mini-batch without rows makes no step.
    """
    spark = features.sparkSession
    inputs = list(inputs)
    fine = F.col(label).between(0, classes - 1)
    for c in inputs:
        fine = fine & F.col(c).isNotNull()
    rows = features.where(fine).where("split in ('train', 'val')")
    config = {"inputs": inputs, "classes": classes, "steps": steps, "rate": rate, "seed": seed}
    done = epochs_of(spark, folder).orderBy("epoch").collect()  # a row for each epoch
    if done:
        if any(done[-1][c] != v for c, v in config.items()):
            raise ValueError(f"{folder} holds epochs of another configuration")
        state = _checkpoint(done[-1])
    else:
        stats = rows.where("split = 'train'").agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(inputs)),
                                                  *(F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(inputs))).first()
        if stats["m0"] is None:
            raise ValueError("there are no training rows")
        mean = np.array([stats[f"m{k}"] for k in range(len(inputs))])
        scale = np.array([stats[f"s{k}"] or 1.0 for k in range(len(inputs))])
        none = np.zeros((classes, len(inputs) + 1))
        state = Checkpoint(-1, 0, none, none, none, inputs, mean, scale, {})
    scaled = [(F.col(c) - m) / s for c, m, s in zip(inputs, state.mean.tolist(), state.scale.tolist(), strict=True)]
    table = None
    for epoch in range(len(done), epochs):
        if table is None:
            table = materialise(rows.select(
                F.col(key).alias("key"), "split", F.col(label).cast("int").alias("y"), F.array(*scaled, F.lit(1.0)).alias("x")), "epochs")
        train = table.where("split = 'train'").withColumn("batch", batch_number("key", seed, epoch, steps))
        losses, hits, seen = [], 0.0, 0.0
        for batch in range(steps):
            sums = _sums(train.where(F.col("batch") == batch), state.weights)
            if not sums[-1]:
                continue
            losses.append(sums[-3] / sums[-1])
            hits, seen = hits + sums[-2], seen + sums[-1]
            state = adam(state, sums[:-3].reshape(state.weights.shape) / sums[-1], rate)
        judged = _sums(table.where("split = 'val'"), state.weights)
        n = judged[-1]
        state.epoch = epoch
        state.figures = {
            "train_loss": float(np.mean(losses)), "train_acc": float(100 * hits / seen),
            "val_loss": float(judged[-3] / n) if n else None, "val_acc": float(100 * judged[-2] / n) if n else None}
        row = {"epoch": epoch, "step": state.step, "weights": state.weights.ravel().tolist(), "first": state.first.ravel().tolist(),
               "second": state.second.ravel().tolist(), "mean": state.mean.tolist(), "scale": state.scale.tolist(), **config, **state.figures}
        names = [part.split()[0] for part in STATE.split(", ")]
        spark.createDataFrame([tuple(row[c] for c in names)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch_{epoch:05d}")
    return epochs_of(spark, folder).where(F.col("epoch") < epochs).select(
        F.lit(run).alias("run"), "epoch", "train_loss", "train_acc", "val_loss", "val_acc")
