"""MLlib jobs on frame features: classify the source and the level, fit the parameters.

These stand where a deep network is trained elsewhere; results are comparable in
kind only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframes.functions.scoring import spread
from roadframes.operators.metrics import base_metrics
from roadframes.operators.summary import best_run

FEATURES = ["r_mean", "g_mean", "b_mean", "r_std", "g_std", "b_std", "edge_density"]
PARAMETERS = ["density", "congestion", "flow_rate"]


def frame_features(frames: DataFrame, edge_threshold: int = 50) -> DataFrame:
    """Per-channel mean and spread and the edge density of usable frames, with their scores."""
    counts = base_metrics(frames, edge_threshold, by_channel=True).where("valid")
    means = {f"{c}_mean": F.col(f"{c}_sum").cast("double") / F.col("px") for c in "rgb"}
    stds = {f"{c}_std": spread(F.col(f"{c}_sum"), F.col(f"{c}_sumsq"), F.col("px")) for c in "rgb"}
    kept = [c for c in frames.columns if c != "pixels"]
    return counts.withColumns({**means, **stds}).select(*kept, *FEATURES, *PARAMETERS)


def _pipeline(inputs: Sequence[str], output: str, estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol=output), estimator])


def fit_source_classifier(features: DataFrame, label: str = "label", max_iter: int = 50) -> PipelineModel:
    """Two classes, labelled by source."""
    return _pipeline(FEATURES, "features", LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=max_iter)).fit(features)


def fit_level_classifier(
    metrics: DataFrame, hidden: int = 128, seed: int = 0, max_iter: int = 50, label: str = "traffic_level"
) -> PipelineModel:
    """Density, congestion and flow rate to five levels through one hidden layer."""
    return _pipeline(PARAMETERS, "parameters", MultilayerPerceptronClassifier(
        featuresCol="parameters", labelCol=label, layers=[3, hidden, 5], seed=seed, maxIter=max_iter)).fit(metrics)


def fit_parameter_heads(features: DataFrame, inputs: Sequence[str] = FEATURES) -> dict[str, PipelineModel]:
    """One regression for each traffic parameter."""
    return {
        name: _pipeline(inputs, f"{name}_inputs", LinearRegression(
            featuresCol=f"{name}_inputs", labelCol=name, predictionCol=f"{name}_predicted")).fit(features)
        for name in PARAMETERS}


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the prediction and, for a classifier, the class probabilities as an array."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability"))
    wanted = [c for c in out.columns if c in ("prediction", "probability") or c.endswith("_predicted")]
    return out.select(*df.columns, *[c for c in wanted if c not in df.columns])


def evaluate(scored: DataFrame, label: str = "label", by: Sequence[str] = ("split",)) -> DataFrame:
    """Loss and accuracy per split from class probabilities.

    A probability below 1e-15 counts as 1e-15, so that one certain miss leaves the loss finite."""
    at_label = F.get(F.col("probability"), F.col(label).cast("int"))
    hit = F.col("prediction").cast("int") == F.col(label)
    return scored.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(-F.log(F.greatest(at_label, F.lit(1e-15)))).alias("loss"),
        (F.count_if(hit) * 100.0 / F.count("*")).alias("accuracy"))


def train_runs(
    features: DataFrame, run: str = "source", iterations: Sequence[int] = (1, 2, 5, 10)
) -> tuple[dict[int, PipelineModel], DataFrame]:
    """Fit with growing effort and judge each fit on the validation rows.

    ``features`` has a ``split`` column. The run table has one row per fit.
    """
    train = features.where("split = 'train'")
    models: dict[int, PipelineModel] = {}
    table = None
    for epoch, steps in enumerate(iterations):
        models[epoch] = fit_source_classifier(train, max_iter=steps)
        judged = evaluate(predict(models[epoch], features.where("split in ('train', 'val')")))
        row = judged.groupBy(F.lit(run).alias("run"), F.lit(epoch).alias("epoch")).agg(*[
            F.max(F.when(F.col("split") == split, F.col(value))).alias(f"{split}_{short}")
            for split in ("train", "val") for value, short in (("loss", "loss"), ("accuracy", "acc"))])
        table = row if table is None else table.unionByName(row)
    return models, table


def save_best(models: dict[int, PipelineModel], runs: DataFrame, path: str) -> str:
    """Store the model of the best validation accuracy; returns its folder."""
    best = best_run(runs).first()
    folder = f"{path}/model_epoch_{best['epoch'] + 1}_acc_{best['val_acc']:.2f}"
    models[best["epoch"]].write().overwrite().save(folder)
    return folder
