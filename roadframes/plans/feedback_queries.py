"""Queries on review events, review entries and learnt parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.operators import feedback as fb
from roadframes.operators import metrics as mt
from roadframes.operators.running import beside
from roadframes.plans import standins as st
from roadframes.plans import twins as tw
from roadframes.plans.registry import query, r6

WRONG = "wrong AS (SELECT * FROM reviews WHERE NOT was_correct)"
ERRORS = """errs AS (SELECT avg((user_correction - model_prediction) * density) AS de,
  avg((user_correction - model_prediction) * congestion) AS ce FROM wrong)"""
MEAN_AT = "coalesce(avg(density) FILTER (user_correction = {0}), {1})"
LEARNT = f"""{WRONG}, {ERRORS},
t AS (SELECT {MEAN_AT.format(1, 0.2)} AS t1, {MEAN_AT.format(2, 0.4)} AS t2, {MEAN_AT.format(3, 0.6)} AS t3 FROM wrong),
learnt AS (SELECT greatest(0.1, 1 + 0.1 * de) AS wd, greatest(0.1, 1 + 0.1 * ce) AS wc, t1, t2, t3 FROM errs, t)"""


FOLDED = "SELECT * REPLACE (coalesce(corrected_level, -1) AS corrected_level) FROM folded"


def no_level(folded: DataFrame) -> DataFrame:
    """Show -1 where no level was corrected, so that results hold no NULLs."""
    return folded.withColumn("corrected_level", F.coalesce("corrected_level", F.lit(-1)))


@query(f"WITH {tw.LOG}, {tw.folded()} {FOLDED}")
def fold_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return no_level(fb.fold_reviews(st.review_log(spark, sf)))


@query(f"WITH {tw.LOG}, {tw.folded()} {FOLDED}")
def fold_reviews_evenly(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers from blocks of about equally many events."""
    return no_level(fb.fold_reviews(st.review_log(spark, sf), block=None))


@query(f"WITH {tw.PRESSED} SELECT session, seq, action, coalesce(level, -1) AS level FROM log")
def decode_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Bare keys read in context: a level only after a no, back within the correction, nothing after a quit."""
    return fb.decode_keys(st.key_log(spark, sf)).select("session", "seq", "action", F.coalesce("level", F.lit(-1)).alias("level"))


@query(f"WITH {tw.PRESSED}, {tw.folded()} {FOLDED}")
def fold_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The answers that stand at the end of each session, from bare keys."""
    return no_level(fb.fold_reviews(fb.decode_keys(st.key_log(spark, sf))))


@query(f"""SELECT CASE WHEN {tw.K} % 7 IN (0, 5) THEN 'agree' WHEN {tw.K} % 7 IN (1, 4) THEN 'disagree' WHEN {tw.K} % 7 = 2 THEN 'back'
  WHEN {tw.K} % 7 = 3 THEN 'quit' ELSE 'none' END AS action, count(*) AS n FROM events GROUP BY 1""")
def key_actions(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array(*map(F.lit, ("Y", "n", "B", "q", "0", "1", "x")))
    pressed = st.table(spark, sf, "events").select(F.get(keys, st.k() % 7).alias("key"))
    action = F.coalesce(fb.key_action(F.col("key")), F.lit("none"))
    return pressed.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query(tw.REVIEWS + " SELECT frame_id, model_prediction, user_correction FROM reviews WHERE NOT was_correct")
def wrong_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return fb.wrong_predictions(st.reviews(spark, sf)).select("frame_id", "model_prediction", "user_correction")


@query(tw.REVIEWS + f""", {WRONG} SELECT round(density, 6) AS density, round(congestion, 6) AS congestion,
  model_prediction AS predicted, user_correction AS actual FROM wrong""")
def error_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return fb.error_patterns(st.reviews(spark, sf)).select(
        r6("density", "density"), r6("congestion", "congestion"), "predicted", "actual")


@query(tw.REVIEWS + f", {WRONG}, {ERRORS} SELECT round(de, 6) AS density_error, round(ce, 6) AS congestion_error FROM errs")
def directional_errors(spark: SparkSession, sf: str) -> DataFrame:
    return fb.directional_errors(fb.error_patterns(st.reviews(spark, sf))).select(
        r6("density_error", "density_error"), r6("congestion_error", "congestion_error"))


@query(tw.REVIEWS + f", {WRONG} SELECT CAST(user_correction AS INTEGER) AS level, round(avg(density), 6) AS mean_density FROM wrong GROUP BY 1")
def mean_density_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return fb.mean_density_by_level(fb.error_patterns(st.reviews(spark, sf))).select("level", r6("mean_density", "mean_density"))


@query(tw.REVIEWS + f", {LEARNT} SELECT round(wd, 6) AS density_weight, round(wc, 6) AS congestion_weight FROM learnt")
def learn_weights(spark: SparkSession, sf: str) -> DataFrame:
    return fb.learn_weights(fb.error_patterns(st.reviews(spark, sf))).select(
        r6("density_weight", "density_weight"), r6("congestion_weight", "congestion_weight"))


def _thresholds(df: DataFrame) -> DataFrame:
    return df.select(F.posexplode("thresholds").alias("i", "t")).select(
        (F.col("i") + 1).alias("level"), r6("t", "threshold"))


@query(tw.REVIEWS + f""", {LEARNT} SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS level,
  round(CAST(unnest([t1, t2, t3, 0.8]) AS DOUBLE), 6) AS threshold FROM learnt""")
def learn_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    errors = fb.error_patterns(st.reviews(spark, sf))
    return _thresholds(fb.learn_thresholds(errors, keep_top_threshold=True))


def _params(df: DataFrame) -> DataFrame:
    return df.select(
        r6("density_weight", "density_weight"), r6("congestion_weight", "congestion_weight"), "edge_threshold",
        F.array_join(F.transform("thresholds", lambda t: F.format_string("%.6f", t)), " ").alias("thresholds"))


@query(tw.REVIEWS + f""", {LEARNT} SELECT round(wd, 6) AS density_weight, round(wc, 6) AS congestion_weight,
  CAST(50 AS INTEGER) AS edge_threshold, printf('%.6f %.6f %.6f', t1, t2, t3) AS thresholds FROM learnt""")
def learn_params(spark: SparkSession, sf: str) -> DataFrame:
    return _params(fb.learn_params(st.reviews(spark, sf)))


@query(tw.REVIEWS + """ SELECT CAST(1 AS DOUBLE) AS density_weight, CAST(1 AS DOUBLE) AS congestion_weight, CAST(50 AS INTEGER) AS edge_threshold,
  CASE WHEN count(*) > 0 THEN '0.200000 0.400000 0.600000 0.800000' ELSE '0.100000 0.300000 0.500000 0.700000' END AS thresholds
FROM reviews WHERE was_correct""")
def learn_params_no_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews without a single error: weights stay, the learner's thresholds are taken."""
    return _params(fb.learn_params(st.reviews(spark, sf).where("was_correct")))


@query(tw.REVIEWS + f""", {LEARNT},
again AS (SELECT frame_id, {tw.level('(wd * density + wc * congestion)', ['t1', 't2', 't3'])} AS after FROM metrics, learnt),
checked AS (SELECT count(*) AS n, count(*) FILTER (model_prediction = user_correction) AS a,
  count(*) FILTER (after = user_correction) AS b FROM reviews JOIN again USING (frame_id))
SELECT round(wd, 6) AS density_weight, round(wc, 6) AS congestion_weight, CAST(50 AS INTEGER) AS edge_threshold,
  printf('%.6f %.6f %.6f', t1, t2, t3) AS thresholds, n AS reviewed, a AS agreed_before, b AS agreed_after,
  round(CAST(a AS DOUBLE) / n, 6) AS accuracy_before, round(CAST(b AS DOUBLE) / n, 6) AS accuracy_after FROM learnt, checked""")
def relearn_and_rescore(spark: SparkSession, sf: str) -> DataFrame:
    metrics = st.stored_scores(spark, sf)
    out = fb.relearn_and_rescore(metrics, st.as_reviews(metrics))
    return out.select(
        r6("density_weight", "density_weight"), r6("congestion_weight", "congestion_weight"), "edge_threshold",
        F.array_join(F.transform("thresholds", lambda t: F.format_string("%.6f", t)), " ").alias("thresholds"),
        "reviewed", "agreed_before", "agreed_after",
        r6("accuracy_before", "accuracy_before"), r6("accuracy_after", "accuracy_after"))


@query(tw.REVIEWS + f""", {LEARNT}
SELECT frame_id, {tw.level('(wd * density + wc * congestion)', ['t1', 't2', 't3'])} AS traffic_level FROM metrics, learnt""")
def rescored_levels(spark: SparkSession, sf: str) -> DataFrame:
    metrics = st.stored_scores(spark, sf)
    return mt.rescore(metrics, fb.learn_params(st.as_reviews(metrics))).select("frame_id", "traffic_level")


def shown_frame(folded: DataFrame, frames: DataFrame) -> DataFrame:
    """Which frame each session saw as which image: twelve in a row, from a start of its own."""
    total = frames.agg(F.count("*").alias("_frames"))
    return beside(folded, total).withColumn(
        "frame_id", (F.col("session") * 12 + F.col("image_index")) % F.col("_frames")).drop("_frames")


ENTRIES = f"""WITH RECURSIVE {tw.LOG}, {tw.folded()}, {tw.GRAY}, {tw.metrics('gray', 100)},
entries AS (SELECT session, image_index, CAST(traffic_level AS DOUBLE) AS model_prediction,
  CAST(CASE WHEN was_correct THEN traffic_level ELSE corrected_level END AS DOUBLE) AS user_correction,
  was_correct, density, congestion, answered_at FROM folded
  JOIN metrics ON frame_id = (session * 12 + image_index) % (SELECT count(*) FROM metrics))"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    folded = fb.fold_reviews(st.review_log(spark, sf))
    shown = shown_frame(folded, st.table(spark, sf, "embeddings"))
    return fb.review_entries(shown, st.scored(spark, sf), ["frame_id"])


@query(ENTRIES + " SELECT session, image_index, CAST(model_prediction AS INTEGER) AS traffic_level, round(density, 6) AS density FROM entries")
def attach_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Standing answers with the scores of the frame they speak about."""
    folded = fb.fold_reviews(st.review_log(spark, sf)).select("session", "image_index")
    shown = shown_frame(folded, st.table(spark, sf, "embeddings"))
    return mt.attach_scores(shown, st.scored(spark, sf)).select(
        "session", "image_index", "traffic_level", r6("density", "density"))


@query(ENTRIES + """ SELECT session, image_index, model_prediction, user_correction, was_correct,
  round(density, 6) AS density, round(congestion, 6) AS congestion FROM entries""")
def review_entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).withColumns({c: r6(c) for c in ("density", "congestion")})


@query(ENTRIES + """ SELECT session, count(*) AS total_images, count(*) FILTER (was_correct) AS correct_predictions,
  round(CAST(count(*) FILTER (was_correct) AS DOUBLE) / count(*), 6) AS accuracy FROM entries GROUP BY session""")
def session_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return fb.session_metrics(entries(spark, sf)).withColumn("accuracy", r6("accuracy"))
