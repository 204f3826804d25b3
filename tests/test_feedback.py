import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadframes.operators import feedback as fb
from roadframes.operators import metrics as mt
from roadframes.schemas import FEEDBACK_ENTRY

REVIEW = "frame_id bigint, model_prediction double, user_correction double, was_correct boolean, density double, congestion double"


def fold_by_steps(events, images=12):
    """One session's events in order, as a person would apply them."""
    answers, pos = {}, 0
    for action, level in events:
        if pos >= images or action == "quit":
            break
        if action == "back":
            if pos > 0:
                pos -= 1
                answers.pop(pos, None)
        else:
            answers[pos] = (action == "agree", level if action == "disagree" else None)
            pos += 1
    return answers


def make_events(seed, sessions=12, per=60):
    rng = random.Random(seed)
    start, rows, log = dt.datetime(2024, 1, 1), [], {}
    seq = 0
    for session in range(sessions):
        n = per * 12 if session == 0 else rng.randrange(1, per)
        at, log[session] = start, []
        for _ in range(n):
            at += dt.timedelta(seconds=rng.choice([0, 5, 400, 4000]))
            weights = (30, 20, 49, 1) if session == 0 else (50, 25, 20, 5)
            action = rng.choices(["agree", "disagree", "back", "quit"], weights)[0]
            level = rng.randrange(5)
            rows.append((session, at, seq, action, level))
            log[session].append((action, level))
            seq += 1
    rng.shuffle(rows)
    return rows, log


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_step_by_step(spark, seed):
    rows, log = make_events(seed)
    df = spark.createDataFrame(rows, "session bigint, ts timestamp_ntz, seq bigint, action string, level int")
    got = {}
    for r in fb.fold_reviews(df).collect():
        got.setdefault(r.session, {})[r.image_index] = (r.was_correct, r.corrected_level)
    want = {s: fold_by_steps(e) for s, e in log.items()}
    assert got == {s: a for s, a in want.items() if a}


@pytest.mark.parametrize("block", ["1 minute", "1 hour", "30 days"])
def test_fold_does_not_depend_on_the_block(spark, block):
    rows, _ = make_events(7)
    df = spark.createDataFrame(rows, "session bigint, ts timestamp_ntz, seq bigint, action string, level int")
    want = sorted(fb.fold_reviews(df).select("session", "image_index", "was_correct").collect())
    assert sorted(fb.fold_reviews(df, block=block).select("session", "image_index", "was_correct").collect()) == want


def test_review_sessions_do_not_depend_on_the_block(spark):
    rows, _ = make_events(8)
    df = spark.createDataFrame(rows, "session bigint, ts timestamp_ntz, seq bigint, action string, level int").select(
        F.col("session").alias("reviewer"), "ts", (F.col("action") == "agree").alias("was_correct"))
    a = sorted(fb.review_sessions(df, "1 hour", "10 minutes").collect())
    b = sorted(fb.review_sessions(df, "1 hour", "90 days").collect())
    assert a == b and sum(r.total for r in a) == len(rows)


def reviews(spark, *rows):
    data = [(i, float(p), float(u), p == u, d, c) for i, (p, u, d, c) in enumerate(rows)]
    return spark.createDataFrame(data, REVIEW)


def learnt(df, **options):
    row = fb.learn_params(df, **options).first()
    return round(row.density_weight, 9), round(row.congestion_weight, 9), row.edge_threshold, [round(t, 9) for t in row.thresholds]


def test_learning_cases(spark):
    assert learnt(reviews(spark, (1, 1, 0.5, 0.5)).limit(0)) == (1.0, 1.0, 50, [0.1, 0.3, 0.5, 0.7])
    assert learnt(reviews(spark, (1, 1, 0.5, 0.5))) == (1.0, 1.0, 50, [0.2, 0.4, 0.6, 0.8])
    some = reviews(spark, (1, 1, 0.9, 0.9), (4, 2, 0.5, 1.0), (3, 2, 0.7, 0.2), (0, 4, 0.1, 0.1))
    # density: (-2*.5 - 1*.7 + 4*.1) / 3, congestion: (-2*1 - 1*.2 + 4*.1) / 3
    assert learnt(some) == (round(1 - 0.13 / 3, 9), round(1 - 0.18 / 3, 9), 50, [0.2, 0.6, 0.6])
    assert learnt(some, keep_top_threshold=True)[3] == [0.2, 0.6, 0.6, 0.8]
    assert learnt(some, lr=100.0)[:2] == (0.1, 0.1)


def test_parts_and_whole_learn_the_same(spark):
    errors = fb.error_patterns(reviews(spark, (4, 2, 0.5, 1.0), (3, 2, 0.7, 0.2), (0, 4, 0.1, 0.1)))
    weights, thresholds = fb.learn_weights(errors).first(), fb.learn_thresholds(errors).first()
    whole = learnt(reviews(spark, (4, 2, 0.5, 1.0), (3, 2, 0.7, 0.2), (0, 4, 0.1, 0.1)))
    assert (round(weights[0], 9), round(weights[1], 9)) == whole[:2]
    assert [round(t, 9) for t in thresholds[0]] == whole[3]


def test_sums_of_parts_add_up(spark):
    a, b = reviews(spark, (4, 2, 0.5, 1.0), (1, 1, 0.3, 0.3)), reviews(spark, (3, 2, 0.7, 0.2))
    together = fb.feedback_sums(a.union(b)).first()
    parts = fb.add_sums(fb.feedback_sums(a).union(fb.feedback_sums(b))).first()
    assert together == parts


def test_level_four_is_out_of_reach_after_learning(spark):
    metrics = spark.createDataFrame([(0, True, 1.0, 1.0, 4, 2.0)], "frame_id bigint, valid boolean, density double, congestion double, traffic_level int, traffic_score double")
    out = mt.rescore(metrics, fb.learn_params(reviews(spark, (4, 2, 0.5, 1.0)))).first()
    assert out.traffic_level == 3


def test_session_metrics(spark):
    df = reviews(spark, (1, 1, 0.1, 0.1), (1, 2, 0.1, 0.1)).withColumn("session", F.lit(5))
    assert tuple(fb.session_metrics(df).first()) == (5, 2, 1, 0.5)


def test_flatten_and_keys(spark):
    entry = (0, 1.0, 1.0, True, 0.5, 0.5)
    from pyspark.sql import types as T
    df = spark.createDataFrame([([entry, entry],), ([],)], T.StructType([T.StructField("feedback", T.ArrayType(FEEDBACK_ENTRY))]))
    assert fb.flatten_feedback(df).count() == 2
    keys = spark.createDataFrame([(k,) for k in "Y1n0bqx"], "k string")
    assert [r[0] for r in keys.select(fb.key_action(F.col("k"))).collect()] == ["agree", "agree", "disagree", "disagree", "back", "quit", None]
