"""Counts, histograms, capture cadence and run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadframes.operators.running import beside, running

METRICS = ["density", "congestion", "flow_rate", "traffic_level"]


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"))


def with_bounds(df: DataFrame, value: str) -> DataFrame:
    """Put the smallest and largest value beside every row."""
    return beside(df, df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))


def _filled(counts: DataFrame, keys: Sequence[str], place: str, last: Column | None = None) -> DataFrame:
    """Rows with count 0 for the places between 0 and the last one that have no row.

    Each row also yields the empty places before it, and the group's final row those
    up to ``last``. ``counts`` has one small row per key and place.
    """
    order = Window.partitionBy(*keys).orderBy(place)
    after = F.lead(place).over(order)
    up_to = F.col(place) if last is None else F.when(after.isNull(), last).otherwise(F.col(place))
    spread = counts.withColumn("_first", F.coalesce(F.lag(place).over(order) + 1, F.lit(0))).withColumn("_upto", up_to)
    return spread.withColumn("_place", F.explode(F.sequence("_first", "_upto"))).withColumn(
        "rows", F.when(F.col("_place") == F.col(place), F.col("rows")).otherwise(0)
    ).drop(place, "_first", "_upto").withColumnRenamed("_place", place)


def histograms(df: DataFrame, values: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histograms of several columns: one row per metric and bin, empty bins too.

    Two passes: bounds, then counts. Both are partial aggregates, so one small row per metric and bin is
    shuffled and nothing is collected. The bounds are scalar subqueries, and a row gives one number for each
    column, which holds metric and bin: nothing is joined. Constant input is widened by
    a half on both sides; the last bin is closed. Values that are NULL, NaN or infinite
    are in no bin and do not move the bounds.
    """
    finite = {v: F.when(F.abs(F.col(v).cast("double")) < float("inf"), F.col(v).cast("double")) for v in values}
    ends = [(F.min(finite[v]), F.max(finite[v])) for v in values]
    bounds = df.agg(*[
        F.when(lo == hi, F.struct((lo - 0.5).alias("lo"), (hi + 0.5).alias("hi"))).otherwise(
            F.struct(lo.alias("lo"), hi.alias("hi"))).alias(f"_{i}") for i, (lo, hi) in enumerate(ends)])
    placed = beside(df.select(*[finite[v].alias(f"v{i}") for i, v in enumerate(values)]), bounds)

    def code(i: int) -> Column:
        """The bin of a value and its column in one number; NULL where the value is in no bin."""
        lo, hi = F.col(f"_{i}.lo"), F.col(f"_{i}.hi")
        index = F.floor(F.try_divide(F.col(f"v{i}") - lo, hi - lo) * bins)
        return F.when(F.col(f"v{i}").isNotNull(), F.least(F.lit(bins - 1), index) + i * bins)

    codes = [code(i) for i in range(len(values))]
    coded = placed.select((codes[0] if len(codes) == 1 else F.explode(F.array(*codes))).alias("code"))
    counts = coded.where("code is not null").groupBy("code").agg(F.count("*").alias("rows"))
    which, span = F.floor(F.col("code") / bins).cast("int"), F.array(*[F.col(f"_{i}") for i in range(len(values))])
    keyed = beside(counts, bounds).select(
        F.get(F.array(*[F.lit(v) for v in values]), which).alias("metric"), F.get(span, which).alias("span"),
        (F.col("code") - which * bins).cast("int").alias("bin"), "rows").select(
            "metric", F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"), "bin", "rows")
    width = (F.col("hi") - F.col("lo")) / bins
    return _filled(keyed, ["metric", "lo", "hi"], "bin", F.lit(bins - 1)).select(
        "metric", "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "rows")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    return histograms(df, [value], bins).drop("metric")


def distributions(metrics: DataFrame, bins: int = 30) -> DataFrame:
    """Histograms of the four traffic parameters in one pass after their bounds."""
    return histograms(metrics, METRICS, bins)


def level_counts(df: DataFrame, level: str = "traffic_level") -> DataFrame:
    """Rows per level from 0 to the highest one seen, zeros included."""
    counts = df.groupBy(F.col(level).cast("int").alias("level")).agg(F.count("*").alias("rows"))
    return _filled(counts.where("level >= 0"), [], "level")


def batch_outcomes(df: DataFrame, valid: str = "valid") -> DataFrame:
    return df.groupBy("batch_id").agg(
        F.count_if(valid).alias("successful"), F.count_if(~F.col(valid)).alias("failed"))


def job_rates(log: DataFrame) -> DataFrame:
    """Attempts, successes, success rate, hours and rows per second of each job.

    The log has one row per attempted item: ``job``, ``at``, ``ok``.
    """
    seconds = _seconds(F.max("at"), F.min("at"))
    return log.groupBy("job").agg(
        F.count("*").alias("attempted"), F.count_if("ok").alias("processed"), seconds.alias("seconds")
    ).select(
        "job", "attempted", "processed",
        F.coalesce(F.try_divide(F.col("processed") * 100.0, "attempted"), F.lit(0.0)).alias("success_rate"),
        (F.col("seconds") / 3600).alias("hours"),
        F.try_divide(F.col("processed").cast("double"), F.col("seconds")).alias("per_second"))


def _seconds(later: Column, earlier: Column) -> Column:
    return (later - earlier).cast("interval second").cast("decimal(20,6)").cast("double")


def range_and_shape(df: DataFrame) -> DataFrame:
    """Value range and number of distinct shapes over all frames."""
    return df.agg(
        F.count("*").alias("frames"),
        F.min(F.array_min("pixels")).alias("min_value"),
        F.max(F.array_max("pixels")).alias("max_value"),
        F.count_distinct("height", "width", "channels").alias("shapes"))


def collate(batched: DataFrame) -> DataFrame:
    """Ids and labels of each batch, in id order. Pixels are not gathered here."""
    rows = F.sort_array(F.collect_list(F.struct("frame_id", "label")))
    return batched.groupBy("batch_id").agg(rows.alias("_rows")).select(
        "batch_id", F.col("_rows.frame_id").alias("frame_ids"), F.col("_rows.label").alias("labels"))


def capture_slot(at: Column, every: str) -> Column:
    return F.window(at, every)["start"]


def capture_gaps(captures: DataFrame, every: str = "15 minutes") -> DataFrame:
    """Slots between a camera's first and last capture in which it has none."""
    seen = captures.groupBy("camera", capture_slot(F.col("captured_at"), every).alias("slot")).agg(
        F.count("*").alias("rows"))
    span = seen.groupBy("camera").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    expected = span.select(
        "camera", F.explode(F.sequence("first", "last", F.expr(f"interval {every}"))).alias("slot"))
    return expected.join(seen, ["camera", "slot"], "left_anti")


# --- training runs -----------------------------------------------------------


def epoch_metrics(run: DataFrame) -> DataFrame:
    """Loss as the mean of the batches' means, accuracy over all rows, per epoch."""
    per_batch = run.groupBy("epoch", "batch_id").agg(
        F.avg("loss").alias("_loss"), F.count("*").alias("_total"),
        F.count_if(F.col("prediction") == F.col("label")).alias("_correct"))
    return per_batch.groupBy("epoch").agg(
        F.avg("_loss").alias("loss"),
        (F.sum("_correct") * 100.0 / F.sum("_total")).alias("accuracy"))


def running_metrics(run: DataFrame, order: Sequence[str], block: str) -> DataFrame:
    """Loss so far over rows so far, and accuracy so far, inside each epoch.

    ``run`` has one row per batch: ``epoch``, ``loss``, ``correct``, ``total``.
    """
    scanned = running(run, ["epoch"], block, order, {
        "_loss": ("sum", "loss"), "_correct": ("sum", "correct"), "_total": ("sum", "total")})
    return scanned.select(
        *run.columns,
        (F.col("_loss") / F.col("_total")).alias("running_loss"),
        (F.col("_correct") * 100.0 / F.col("_total")).alias("running_accuracy"))


def improvements(runs: DataFrame, value: str = "val_acc", epochs_per_block: int = 256) -> DataFrame:
    """Mark the epochs whose value beats every earlier one of the run, starting from 0."""
    blocked = runs.withColumn("_epochs", F.floor(F.col("epoch") / epochs_per_block))
    best = running(blocked, ["run"], "_epochs", ["epoch"], {"best_before": ("max", value)}, exclusive=True)
    before = F.coalesce("best_before", F.lit(0.0))
    return best.drop("_epochs").withColumns({"best_before": before, "improved": F.col(value) > before})


def best_run(runs: DataFrame, value: str = "val_acc") -> DataFrame:
    """The first epoch with the best value of each run, among values above 0."""
    return runs.where(F.col(value) > 0).groupBy("run").agg(
        F.max_by("epoch", F.struct(F.col(value), -F.col("epoch"))).alias("epoch"), F.max(value).alias(value))


def argmax_prediction(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cross_entropy(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """Mean of minus log softmax at the label."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    loss = top + F.log(total) - F.get(F.col(scores), F.col(label))
    return df.agg(F.avg(loss).alias("cross_entropy"), F.count("*").alias("rows"))


def squared_error(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean squared error per named (prediction, target) pair."""
    return df.agg(*[
        F.avg(F.pow(F.col(p) - F.col(t), 2)).alias(name) for name, (p, t) in pairs.items()])
