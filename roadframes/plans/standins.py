"""The given tables read as frames, captures, reviews and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.functions.names import capture_name
from roadframes.operators.metrics import analyze
from roadframes.session import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _source() -> Column:
    return F.when(F.col("label") < 5, "src_a").otherwise("src_b")


def _frames(emb: DataFrame, channels: int, layout: str, pixels: Column) -> DataFrame:
    return emb.select(
        F.col("vec_id").alias("frame_id"), _source().alias("source"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(channels).alias("channels"),
        F.lit(layout).alias("layout"), pixels.cast("array<float>").alias("pixels"), "label")


def _bytes() -> Column:
    return F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))


def gray_frames(spark: SparkSession, sf: str) -> DataFrame:
    """8 by 8, one channel, 0 to 255."""
    return _frames(table(spark, sf, "embeddings"), 1, "HWC", _bytes())


def rgb_frames(spark: SparkSession, sf: str) -> DataFrame:
    """8 by 8, three channels first: the values, their negative image, their reverse."""
    px = F.col("px")
    emb = table(spark, sf, "embeddings").withColumn("px", _bytes())
    return _frames(emb, 3, "CHW", F.concat(px, F.transform(px, lambda v: 255 - v), F.reverse(px)))


def tensor_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised tensors, three channels first: the values, negated, reversed."""
    e = F.col("embedding")
    return _frames(table(spark, sf, "embeddings"), 3, "CHW", F.concat(e, F.transform(e, lambda v: -v), F.reverse(e)))


def scored(spark: SparkSession, sf: str, edge_threshold: int = 100) -> DataFrame:
    return analyze(gray_frames(spark, sf), edge_threshold)


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The scores as a stored table: what reads them twice does not read pixels twice."""
    return materialise(scored(spark, sf), "scores")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Every scored frame reviewed once; the reviewer's level comes from the label."""
    return as_reviews(scored(spark, sf))


def as_reviews(metrics: DataFrame) -> DataFrame:
    actual = F.col("label") % 5
    return metrics.select(
        "frame_id", F.col("frame_id").alias("image_index"),
        F.col("traffic_level").cast("double").alias("model_prediction"),
        actual.cast("double").alias("user_correction"),
        (F.col("traffic_level") == actual).alias("was_correct"), "density", "congestion")


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """One capture per event, named by one convention or the other."""
    camera, at = F.col("event_type"), F.col("ts")
    name = F.when(F.col("event_id") % 2 == 0, capture_name(camera, at)).otherwise(
        capture_name(camera, at, time_first=True, extension="_cropped.png"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("capture_id"), F.col("event_type").alias("camera"),
        F.col("ts").alias("captured_at"), F.concat(F.lit("/captures/"), name).alias("path"))


def review_log(spark: SparkSession, sf: str) -> DataFrame:
    """Keys pressed in review sessions, one session per user."""
    action = F.when(k() < 60, "agree").when(k() < 85, "disagree").when(k() < 97, "back").otherwise("quit")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"),
        action.alias("action"), (k() % 5).alias("level"))


KEYS = ("y", "N", "1", "n", "0", "b", "2", "x", "3", "Y", "4", "n")


def key_log(spark: SparkSession, sf: str) -> DataFrame:
    """Bare keys pressed in review sessions, one session per user."""
    key = F.when(k() == 99, "q").otherwise(F.get(F.array(*map(F.lit, KEYS)), k() % len(KEYS)))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), key.alias("key"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows: an epoch per day, a batch per quarter of an hour."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("bigint").alias("batch_id"),
        "ts", F.col("event_id").alias("seq"), F.log1p("value").alias("loss"),
        (k() % 2).alias("label"), F.when(k() % 3 == 0, 1).otherwise(0).alias("prediction"))
