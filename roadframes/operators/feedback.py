"""Review events, review entries, and what is learnt from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadframes.operators.automaton import Machine, decode
from roadframes.operators.metrics import rescore
from roadframes.operators.running import beside, ordered_blocks
from roadframes.schemas import LEARNER_THRESHOLDS, SCORER_DEFAULTS

# What each key of the review prompt means.
KEY_ACTIONS = {"y": "agree", "1": "agree", "n": "disagree", "0": "disagree", "b": "back", "q": "quit"}


def key_action(key: Column) -> Column:
    """The action behind a pressed key; NULL for a key with no meaning."""
    pairs = [F.lit(x) for pair in KEY_ACTIONS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(key))


# The review prompt asks a question; after a no it asks for a level, where b returns to the question.
REVIEW_PROMPT = Machine("question", {
    **{("question", key): ("question", ("agree", None)) for key in ("y", "1")},
    **{("question", key): ("correction", None) for key in ("n", "0")},
    ("question", "b"): ("question", ("back", None)),
    **{("correction", str(level)): ("question", ("disagree", level)) for level in range(5)},
    ("correction", "b"): ("question", None),
    **{(state, "q"): ("over", ("quit", None)) for state in ("question", "correction")}})


def decode_keys(presses: DataFrame) -> DataFrame:
    """Review events from the keys pressed, each read in the state that the keys before it led to.

    ``presses`` has ``session``, ``ts``, ``seq`` and ``key``; the result has ``action`` and ``level`` in place of the key, and
    only rows where something was said: a no counts with the level that follows it, other keys are ignored,
    and after a quit the session says nothing.
    """
    pressed = presses.select("session", "ts", "seq", F.lower("key").alias("key"))
    said = decode(pressed, REVIEW_PROMPT, ["session"], ["ts", "seq"], "key", {"action": "string", "level": "int"})
    return said.where("action is not null").drop("key")


def step_of(action: Column) -> Column:
    return F.when(action.isin("agree", "disagree"), 1).when(action == "back", -1).otherwise(0)


def fold_reviews(events: DataFrame, images: int = 12, block: str | None = "1 hour") -> DataFrame:
    """The answers that stand at the end of each review session, one per image.

    ``events`` has ``session``, ``ts``, ``seq``, ``action`` (agree, disagree, back,
    quit) and ``level`` (the corrected level). An answer moves one image on; back
    moves one image back and takes that answer away, and does nothing at the first
    image. A session ends at the first quit, or when all images have an answer.

    The position is a walk that cannot fall below 0: the running sum of the moves
    less its running minimum. It is scanned in time blocks, so the hours of one very
    long session are worked on apart. Whether a session ends inside a block follows
    from the block's totals, so later blocks are dropped before their rows are placed.
    Without ``block`` the borders are quantiles of the rows, so a session that says very
    much in one hour is spread as well, for one more writing of the events.
    """
    blocks = ordered_blocks(events, ["session"], ["ts", "seq"]) if block is None else events.withColumn(
        "_block", F.window("ts", block)["start"])
    ev = blocks.withColumn("_step", step_of(F.col("action")))
    inside = Window.partitionBy("session", "_block").orderBy("ts", "seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("session").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    local = ev.withColumn("_sum", F.sum("_step").over(inside)).withColumn("_low", F.min("_sum").over(inside))
    blocks = local.groupBy("session", "_block").agg(
        F.sum("_step").alias("_moves"), F.min("_sum").alias("_lowest"), F.max("_sum").alias("_highest"),
        F.max(F.col("_sum") - F.col("_low")).alias("_climb"), F.count_if(F.col("action") == "quit").alias("_quits"))
    # position = max(from + sum - floor, sum - low), with from and floor known per block
    carried = blocks.withColumn("_from", F.coalesce(F.sum("_moves").over(across), F.lit(0))).withColumn(
        "_floor", F.least(F.lit(0), F.min(F.col("_from") + F.col("_lowest")).over(across)))
    reached = F.greatest(F.col("_from") + F.col("_highest") - F.col("_floor"), F.col("_climb"))
    open_blocks = carried.withColumn("_ends", ((F.col("_quits") > 0) | (reached >= images)).cast("int")).withColumn(
        "_over", F.max("_ends").over(across)).where("_over is null or _over = 0").select(
        "session", "_block", "_from", "_floor")
    position = F.greatest(F.col("_from") + F.col("_sum") - F.col("_floor"), F.col("_sum") - F.col("_low"))
    placed = local.join(open_blocks, ["session", "_block"]).select(
        *ev.columns, position.cast("bigint").alias("_pos"))
    ends = F.when((F.col("action") == "quit") | (F.col("_pos") >= images), 1)
    before = Window.partitionBy("session", "_block").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    live = placed.withColumn("_ended", F.count(ends).over(before)).where("_ended = 0")

    # Per session and position: what its last event was. A session has at most images + 1
    # positions, so everything after this count is small, however many moves were made.
    when = F.struct("ts", "seq")
    answer = F.when(F.col("_step") == 1, F.struct("action", "level", "ts"))
    places = live.groupBy("session", "_pos").agg(
        F.max(when).alias("_left"),
        F.max_by(answer, F.when(F.col("_step") == 1, when)).alias("_answer"))
    last = F.max_by("_pos", "_left").over(Window.partitionBy("session"))
    return places.withColumn("_last", last).where("_answer is not null and _pos <= _last").select(
        "session", (F.col("_pos") - 1).alias("image_index"),
        (F.col("_answer.action") == "agree").alias("was_correct"),
        F.when(F.col("_answer.action") == "disagree", F.col("_answer.level")).alias("corrected_level"),
        F.col("_answer.ts").alias("answered_at"))


def review_entries(folded: DataFrame, scored: DataFrame, on: Sequence[str] = ("session", "image_index")) -> DataFrame:
    """Folded answers with the scores of the images shown, as feedback entries.

    ``scored`` has the ``on`` columns, ``traffic_level``, ``density`` and
    ``congestion``. Agreeing confirms the predicted level.
    """
    level = F.col("traffic_level")
    scores = scored.select(*on, "traffic_level", "density", "congestion")
    return folded.join(scores, list(on)).select(
        "session", "image_index",
        level.cast("double").alias("model_prediction"),
        F.when(F.col("was_correct"), level).otherwise(F.col("corrected_level")).cast("double").alias("user_correction"),
        "was_correct", "density", "congestion")


def flatten_feedback(sessions: DataFrame) -> DataFrame:
    """All entries of all sessions."""
    return sessions.select(F.inline("feedback"))


def wrong_predictions(reviews: DataFrame) -> DataFrame:
    return reviews.where(~F.col("was_correct"))


def error_patterns(reviews: DataFrame) -> DataFrame:
    return wrong_predictions(reviews).select(
        "density", "congestion",
        F.col("model_prediction").alias("predicted"), F.col("user_correction").alias("actual"))


def directional_errors(errors: DataFrame) -> DataFrame:
    """Mean of (actual - predicted) times density, and times congestion."""
    off = F.col("actual") - F.col("predicted")
    return errors.agg(
        F.avg(off * F.col("density")).alias("density_error"),
        F.avg(off * F.col("congestion")).alias("congestion_error"))


def mean_density_by_level(errors: DataFrame) -> DataFrame:
    return errors.groupBy(F.col("actual").cast("int").alias("level")).agg(F.avg("density").alias("mean_density"))


def session_metrics(reviews: DataFrame) -> DataFrame:
    """Images, correct ones and accuracy of each session."""
    return reviews.groupBy("session").agg(
        F.count("*").alias("total_images"), F.count_if("was_correct").alias("correct_predictions")
    ).withColumn("accuracy", F.coalesce(
        F.try_divide(F.col("correct_predictions").cast("double"), "total_images"), F.lit(0.0)))


def feedback_sums(reviews: DataFrame) -> DataFrame:
    """One row of sums from which parameters follow; sums of parts can be added."""
    wrong = ~F.col("was_correct")
    off = F.col("user_correction") - F.col("model_prediction")
    at = F.col("user_correction").cast("int")
    zero = F.lit(0.0)
    return reviews.agg(
        F.count("*").alias("reviewed"),
        F.count_if(wrong).alias("wrong"),
        F.coalesce(F.sum(F.when(wrong, off * F.col("density"))), zero).alias("density_off"),
        F.coalesce(F.sum(F.when(wrong, off * F.col("congestion"))), zero).alias("congestion_off"),
        *[F.count_if(wrong & (at == i)).alias(f"n_{i}") for i in (1, 2, 3)],
        *[F.coalesce(F.sum(F.when(wrong & (at == i), F.col("density"))), zero).alias(f"density_{i}") for i in (1, 2, 3)])


def add_sums(sums: DataFrame) -> DataFrame:
    return sums.agg(*[F.sum(c).alias(c) for c in sums.columns])


def _weight(error: Column, lr: float, floor: float) -> Column:
    return F.greatest(F.lit(floor), F.lit(1.0) + F.lit(lr) * error)


def learn_weights(errors: DataFrame, lr: float = 0.1, floor: float = 0.1) -> DataFrame:
    """Weights move from 1.0 along the mean directional errors, but not below ``floor``."""
    return directional_errors(errors).select(
        _weight(F.coalesce("density_error", F.lit(0.0)), lr, floor).alias("density_weight"),
        _weight(F.coalesce("congestion_error", F.lit(0.0)), lr, floor).alias("congestion_weight"))


def learn_thresholds(
    errors: DataFrame, default: list[float] = LEARNER_THRESHOLDS, keep_top_threshold: bool = False
) -> DataFrame:
    """Thresholds of levels 1 to 3: mean density of the errors with that actual level."""
    at = F.col("actual").cast("int")
    top = [F.lit(default[3])] if keep_top_threshold else []
    return errors.agg(F.array(*[
        F.coalesce(F.avg(F.when(at == i, F.col("density"))), F.lit(default[i - 1])) for i in (1, 2, 3)
    ], *top).alias("thresholds"))


def params_from_sums(
    sums: DataFrame, lr: float = 0.1, floor: float = 0.1, keep_top_threshold: bool = False
) -> DataFrame:
    """The three cases: no reviews, reviews without errors, reviews with errors.

    Without reviews the scorer keeps its defaults. Without errors the learner's own
    four thresholds are taken. With errors three thresholds are learnt, so level 4
    is out of reach unless ``keep_top_threshold`` keeps the fourth.
    """
    def weight(name: str) -> Column:
        return F.when(
            F.col("wrong") > 0, _weight(F.try_divide(F.col(name), F.col("wrong")), lr, floor)).otherwise(1.0)

    top = [F.lit(LEARNER_THRESHOLDS[3])] if keep_top_threshold else []
    learnt = F.array(*[
        F.coalesce(F.try_divide(F.col(f"density_{i}"), F.col(f"n_{i}")), F.lit(LEARNER_THRESHOLDS[i - 1]))
        for i in (1, 2, 3)], *top)

    def fixed(values: list[float]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    thresholds = (
        F.when(F.coalesce(F.col("reviewed"), F.lit(0)) == 0, fixed(SCORER_DEFAULTS["thresholds"]))
        .when(F.col("wrong") == 0, fixed(LEARNER_THRESHOLDS))
        .otherwise(learnt))
    return sums.select(
        weight("density_off").alias("density_weight"),
        weight("congestion_off").alias("congestion_weight"),
        F.lit(SCORER_DEFAULTS["edge_threshold"]).alias("edge_threshold"),
        thresholds.alias("thresholds"))


def learn_params(reviews: DataFrame, lr: float = 0.1, floor: float = 0.1, keep_top_threshold: bool = False) -> DataFrame:
    return params_from_sums(feedback_sums(reviews), lr, floor, keep_top_threshold)


def relearn_and_rescore(metrics: DataFrame, reviews: DataFrame, **options) -> DataFrame:
    """Learn from the reviews, score every frame again, compare with the reviewers.

    ``metrics`` and ``reviews`` are read more than once: pass stored tables of scores.
    One row: the new parameters, and the share of reviewed frames on whose level
    the reviewers agree before and after. ``reviews`` carries ``frame_id``.
    """
    params = learn_params(reviews, **options)
    again = rescore(metrics, params).select("frame_id", F.col("traffic_level").alias("_after"))
    checked = reviews.join(again, "frame_id").agg(
        F.count("*").alias("reviewed"),
        F.count_if(F.col("model_prediction") == F.col("user_correction")).alias("agreed_before"),
        F.count_if(F.col("_after") == F.col("user_correction")).alias("agreed_after"))

    def share(name: str) -> Column:
        return F.coalesce(F.try_divide(F.col(name).cast("double"), "reviewed"), F.lit(0.0))

    return beside(checked, params).select(
        *params.columns, *checked.columns,
        share("agreed_before").alias("accuracy_before"), share("agreed_after").alias("accuracy_after"))


def review_sessions(events: DataFrame, gap: str = "2 hours", block: str | None = "6 hours") -> DataFrame:
    """Sessions of a reviewer, closed by a pause longer than ``gap``.

    ``events`` has ``reviewer``, ``ts`` and ``was_correct``. The pause before an
    event and the number of its session are scanned in time blocks, so one
    reviewer's long history is spread over many tasks; without ``block`` in blocks of
    about equally many moments.
    """
    # events of one moment belong together; counted first, their order is unique
    moments = events.groupBy("reviewer", "ts").agg(
        F.count("*").alias("_total"), F.count_if("was_correct").alias("_correct")
    )
    moments = ordered_blocks(moments, ["reviewer"], ["ts"]) if block is None else moments.withColumn(
        "_block", F.window("ts", block)["start"])
    pause = F.expr(f"interval {gap}")
    inside = Window.partitionBy("reviewer", "_block").orderBy("ts")
    across = Window.partitionBy("reviewer").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    # pauses inside a block; the pause before its first event follows from earlier blocks
    local = moments.withColumn(
        "_opens", F.coalesce((F.col("ts") > F.lag("ts").over(inside) + pause).cast("int"), F.lit(0)))
    blocks = local.groupBy("reviewer", "_block").agg(
        F.sum("_opens").alias("_opened"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    before = F.max("_last").over(across)
    opened = blocks.withColumn(
        "_first_opens", F.coalesce((F.col("_first") > before + pause).cast("int"), F.lit(1)))
    carried = opened.select("reviewer", "_block", (
        F.coalesce(F.sum(F.col("_opened") + F.col("_first_opens")).over(across), F.lit(0)) + F.col("_first_opens")
    ).alias("_base"))
    so_far = F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = local.withColumn("_so_far", so_far).join(carried, ["reviewer", "_block"])
    return numbered.groupBy("reviewer", (F.col("_base") + F.col("_so_far")).alias("_session")).agg(
        F.min("ts").alias("started_at"), (F.max("ts") + pause).alias("ends_at"),
        F.sum("_total").alias("total"), F.sum("_correct").alias("correct")).drop("_session")
