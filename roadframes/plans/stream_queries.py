"""Streams over the tables, worked through to a stored table that is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.operators import feedback as fb
from roadframes.operators.frames import to_rgb
from roadframes.plans import feedback_queries as fq
from roadframes.plans import source_queries as sq
from roadframes.plans import standins as st
from roadframes.plans import twins as tw
from roadframes.plans.registry import query, r6, weighed
from roadframes.session import scratch_path
from roadframes.streaming import captures as sc
from roadframes.streaming import learning as sl
from roadframes.streaming import reviews as sr
from roadframes.streaming import upsert as up


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    # a pattern, since a stream takes a folder or a pattern, and the table may be one file
    return spark.readStream.schema(st.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    with sr.stream_settings(spark):
        sc.run_to_table(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(f"""WITH {tw.GRAY}, x AS (SELECT frame_id, flatten(list_transform(px, lambda v: [v, v, v])) AS px FROM gray WHERE label <> 9)
SELECT frame_id, CAST(8 AS INTEGER) AS height, CAST(list_sum(list_transform(px, lambda v, i: v * i)) AS BIGINT) AS checksum FROM x
UNION ALL SELECT vec_id, CAST(-1 AS INTEGER), CAST(0 AS BIGINT) FROM embeddings WHERE label = 9""")
def stream_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Image files read as a stream; files that are no images come with height -1."""
    images = sc.stream_captures(spark, sq.image_folder(spark, sf))
    rows = to_rgb(images).select(sq._id_in_name("origin").alias("frame_id"), "height", F.coalesce(weighed(), F.lit(0)).alias("checksum"))
    return _run(spark, rows, "stream-captures")


@query(f"""WITH RECURSIVE {tw.GRAY}, good AS (SELECT frame_id, source, label, px FROM gray WHERE label <> 9), {tw.metrics('good', 100)}
SELECT frame_id, true AS valid, round(density, 6) AS density, round(congestion, 6) AS congestion, traffic_level FROM metrics
UNION ALL SELECT vec_id, false, 0.0, 0.0, 0 FROM embeddings WHERE label = 9""")
def score_stream(spark: SparkSession, sf: str) -> DataFrame:
    images = sc.stream_captures(spark, sq.image_folder(spark, sf))
    scores = sc.score_stream(images, 100).select(
        sq._id_in_name("origin").alias("frame_id"), "valid", r6("density", "density"), r6("congestion", "congestion"),
        "traffic_level")
    return _run(spark, scores, "score-stream")


@query(f"""SELECT event_type AS camera, {tw.SLOT.format('ts')} AS slot, count(*) AS captures FROM events
GROUP BY 1, 2 HAVING {tw.SLOT.format('any_value(ts)')} + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events)""")
def capture_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the slots the watermark has closed."""
    events = _event_stream(spark, sf).select(F.col("event_type").alias("camera"), F.col("ts").alias("captured_at"))
    return _run(spark, sc.capture_slots(events), "capture-slots")


SESSIONS = f"""WITH g AS (SELECT user_id AS reviewer, ts, {tw.K} < 60 AS ok,
  CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, sum(opens) OVER (PARTITION BY reviewer ORDER BY ts) AS nr FROM g),
s AS (SELECT reviewer, min(ts) AS started_at, max(ts) + INTERVAL '2 hours' AS ends_at, count(*) AS total,
  count(*) FILTER (ok) AS correct FROM n GROUP BY reviewer, nr)"""


def _review_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("reviewer"), "ts", (st.k() < 60).alias("was_correct"))


@query(SESSIONS + " SELECT * FROM s")
def review_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions, in a batch."""
    return fb.review_sessions(_review_events(st.table(spark, sf, "events")))


@query(SESSIONS + " SELECT * FROM s")
def review_sessions_evenly(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions, from blocks of about equally many moments."""
    return fb.review_sessions(_review_events(st.table(spark, sf, "events")), block=None)


@query(SESSIONS + " SELECT * FROM s WHERE ends_at + INTERVAL '1 hour' <= (SELECT max(ts) FROM events)")
def review_sessions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions the watermark has closed."""
    return _run(spark, sr.review_sessions_stream(_review_events(_event_stream(spark, sf))), "review-sessions")


@query(f"""WITH {tw.LOG}, due AS (SELECT * FROM log
  WHERE time_bucket(INTERVAL '1 minute', ts) + INTERVAL '16 minutes' <= (SELECT max(ts) FROM events)), {tw.folded('due')}
{fq.FOLDED}""")
def fold_reviews_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Standing answers after the minutes the watermark has passed."""
    events = _event_stream(spark, sf)
    action = F.when(st.k() < 60, "agree").when(st.k() < 85, "disagree").when(st.k() < 97, "back").otherwise("quit")
    log = events.select(
        F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), action.alias("action"),
        (st.k() % 5).alias("level"))
    return fq.no_level(sr.standing_answers(_run(spark, sr.fold_reviews_stream(log, forget=None), "fold-reviews")))


def _latest(spark: SparkSession, stream: DataFrame, name: str, keys: list[str], order: str | None = None) -> DataFrame:
    path = scratch_path(spark, name)
    with sr.stream_settings(spark):
        up.upsert_to_table(stream, f"{path}/out", f"{path}/checkpoint", keys, order)
    return up.read_latest(spark, f"{path}/out", stream, keys, order)


@query(f"SELECT event_type AS camera, {tw.SLOT.format('ts')} AS slot, count(*) AS captures FROM events GROUP BY 1, 2")
def capture_slots_now(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all slots, the open ones included."""
    events = _event_stream(spark, sf).select(F.col("event_type").alias("camera"), F.col("ts").alias("captured_at"))
    return _latest(spark, sc.capture_slots(events), "slots-now", ["camera", "slot"])


@query(SESSIONS + " SELECT * FROM s")
def review_sessions_now(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions, the open ones included."""
    sessions = sr.review_sessions_now(_review_events(_event_stream(spark, sf)))
    return _latest(spark, sessions, "sessions-now", ["reviewer", "started_at"], "step").select(
        "reviewer", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ends_at")), "total", "correct")


@query(f"WITH {tw.LOG}, {tw.folded()} {fq.FOLDED}")
def standing_reviews_now(spark: SparkSession, sf: str) -> DataFrame:
    """Standing answers after all events, those of minutes that the watermark has not passed included."""
    events = _event_stream(spark, sf)
    action = F.when(st.k() < 60, "agree").when(st.k() < 85, "disagree").when(st.k() < 97, "back").otherwise("quit")
    log = events.select(
        F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), action.alias("action"), (st.k() % 5).alias("level"))
    answers = _latest(spark, sr.standing_reviews_stream(log, forget=None), "standing", ["session", "image_index"], "step")
    return fq.no_level(answers.withColumn("answered_at", F.col("answered_at").cast("timestamp_ntz")))


@query(tw.REVIEWS + f""", {fq.LEARNT} SELECT round(wd, 6) AS density_weight, round(wc, 6) AS congestion_weight,
  CAST(50 AS INTEGER) AS edge_threshold, printf('%.6f %.6f %.6f', t1, t2, t3) AS thresholds FROM learnt""")
def online_params(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters learnt batch by batch, one per corrected level."""
    path = scratch_path(spark, "online")
    reviews = st.reviews(spark, sf)
    reviews.repartition("user_correction").write.parquet(f"{path}/reviews")
    stream = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/reviews")
    sl.online_params(stream, f"{path}/learnt", f"{path}/checkpoint").awaitTermination()
    return fq._params(sl.latest_params(spark, f"{path}/learnt"))
