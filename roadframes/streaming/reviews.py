"""Review sessions and answers as streams."""

from __future__ import annotations

import sys
from bisect import insort
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules["roadframes"])

CHANGES = (
    "session bigint, step bigint, op string, image_index bigint, was_correct boolean, corrected_level int, at timestamp")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE_MS = 60_000


@contextmanager
def stream_settings(spark: SparkSession):
    """Settings a stateful query takes when it starts.

    State lives in RocksDB, on disk, as stateful Python operators need; sessions are
    merged inside each task before they are shuffled.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def review_sessions_stream(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a reviewer, closed by a pause longer than ``gap``.

    ``events`` has ``reviewer``, ``ts`` and ``was_correct``.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = timed.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "reviewer").agg(
        F.count("*").alias("total"), F.count_if("was_correct").alias("correct"))
    return sessions.select(
        "reviewer", F.col("w.start").cast("timestamp_ntz").alias("started_at"),
        F.col("w.end").cast("timestamp_ntz").alias("ends_at"), "total", "correct")


class FoldReviews(StatefulProcessor):
    """Applies a session's review events in order of event time.

    An event waits until the watermark has passed its minute; then the passed minutes
    are applied. An ordinary session keeps its waiting events in one state value. A
    session with more than ``SMALL`` of them keeps one state entry per minute, so
    that only one of its minutes is read and sorted at a time; which minutes wait stands in one sorted
    list. Events of a minute already passed are reported as late and not applied. An ended session keeps
    its end alone, and with ``forget`` (milliseconds) not even that once the watermark is so far
    past the session's last event; an id that is used again after that begins a new session.
    """

    SMALL = 1024

    def __init__(self, images: int, forget: int | None = None) -> None:
        self.images, self.forget = images, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", (
            "pos bigint, step bigint, done boolean, timer bigint, by_minute boolean, last bigint, waiting array<bigint>"))
        events = "ts array<bigint>, seq array<bigint>, action array<string>, level array<int>"
        self.small = handle.getValueState("small", events)
        self.minutes = handle.getMapState("minutes", "minute bigint", events)

    def _load(self) -> None:
        self.pos, self.step, self.done, self.timer, self.by_minute, self.last, self.waiting = (
            self.walk.get() or (0, 0, False, 0, False, 0, []))
        self.waiting = list(self.waiting)
        self.held = None  # the waiting events of an ordinary session, once they have been read

    def _few(self) -> list:
        """Waiting events of an ordinary session: each state call goes to the JVM and back, so they are read once."""
        if self.held is None:
            columns = self.small.get()
            self.held = list(zip(*columns)) if columns else []
        return self.held

    def _keep_few(self, events: list) -> None:
        self.held = events
        if events:
            self.small.update(_columns(events))
        else:
            self.small.clear()

    def _save(self) -> None:
        self.walk.update((self.pos, self.step, self.done, self.timer, self.by_minute, self.last, self.waiting))

    def _remember_end(self) -> None:
        """Of an ended session: nothing waits, and a timer may take the rest away."""
        self._keep_few([])
        self.minutes.clear()
        self.waiting, self.timer = [], 0
        if self.forget is not None:
            self.timer = self.last + self.forget
            self.handle.registerTimer(self.timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for changes in self._take(rows, timerValues.getCurrentWatermarkInMs()):
            yield self._changes(key, changes)

    def _take(self, rows: Iterator[pd.DataFrame], passed: int) -> Iterator[list[tuple]]:
        """Lets new events wait; late ones are told."""
        self._load()
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            self.last = max(self.last, int(micros.max()) // 1000)
            if self.done:
                continue
            events = list(zip(micros.tolist(), part["seq"].tolist(), part["action"].tolist(), part["level"].tolist()))
            late = [e for e in events if _minute_end(e) <= passed]
            if late:
                yield [(-1, "late", None, None, None, e[0]) for e in late]
                events = [e for e in events if _minute_end(e) > passed]
            if events:
                self._wait(events)
                first = min(map(_minute_end, events))
                if not self.timer or first < self.timer:
                    self.timer = first
                    self.handle.registerTimer(first)
        self._save()

    def _wait(self, events: list) -> None:
        if not self.by_minute:
            events = self._few() + events
            if len(events) <= self.SMALL:
                self._keep_few(events)
                return
            self.by_minute = True
            self._keep_few([])
        grouped: dict[int, list] = {}
        for event in events:
            grouped.setdefault(_minute_end(event), []).append(event)
        for end, some in grouped.items():
            old = self.minutes.getValue((end,)) if end in self.waiting else None
            if not old:
                insort(self.waiting, end)
            self.minutes.updateValue((end,), _columns((list(zip(*old)) if old else []) + some))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for changes in self._expire(timerValues.getCurrentWatermarkInMs()):
            yield self._changes(key, changes)

    def _expire(self, passed: int) -> Iterator[list[tuple]]:
        """Applies the waiting events whose minute is over."""
        self._load()
        if self.done:
            if self.forget is not None and passed >= self.last + self.forget:
                self._clear()
                return
            self._remember_end()  # events came after the end and put its forgetting off
        else:
            self.timer = 0
            for events in self._passed(passed):
                changes = self._apply(sorted(events))
                if changes:
                    yield changes
                if self.done:
                    break
            if self.done:
                self._remember_end()
            elif self.timer:
                self.handle.registerTimer(self.timer)
        self._save()

    def _clear(self) -> None:
        self.walk.clear()

    def _passed(self, passed: int) -> Iterator[list]:
        """Waiting events whose minute is over, in order; the next timer is set."""
        if not self.by_minute:
            events = self._few()
            if events:
                rest = [e for e in events if _minute_end(e) > passed]
                if rest:
                    self.timer = min(map(_minute_end, rest))
                self._keep_few(rest)
                yield [e for e in events if _minute_end(e) <= passed]
            return
        while self.waiting:
            end = self.waiting[0]
            if end > passed:
                self.timer = end
                return
            events = list(zip(*self.minutes.getValue((end,))))
            self.minutes.removeKey((end,))
            del self.waiting[0]
            yield events

    def _waiting_events(self) -> Iterator[list]:
        """All waiting events in order, a minute at a time where there are many."""
        if not self.by_minute:
            yield sorted(self._few())
            return
        for end in self.waiting:
            yield sorted(zip(*self.minutes.getValue((end,))))

    def _apply(self, events: list) -> list[tuple]:
        out = []
        for us, _, action, level in events:
            if action == "quit":
                self.done = True
            elif action == "back":
                if self.pos > 0:
                    self.pos, self.step = self.pos - 1, self.step + 1
                    out.append((self.step, "retract", self.pos, None, None, us))
            else:
                agreed = action == "agree"
                self.step += 1
                out.append((self.step, "answer", self.pos, agreed, None if agreed else level, us))
                self.pos += 1
                self.done = self.pos >= self.images
            if self.done:
                break
        return out

    @staticmethod
    def _changes(key, rows) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["step", "op", "image_index", "was_correct", "corrected_level", "at"])
        out.insert(0, "session", key[0])
        out["image_index"] = out["image_index"].astype("Int64")
        out["corrected_level"] = out["corrected_level"].astype("Int32")
        out["was_correct"] = out["was_correct"].astype("boolean")
        out["at"] = pd.to_datetime(out["at"], unit="us")
        return out

    def close(self) -> None:
        pass


def _minute_end(event: tuple) -> int:
    return event[0] // 1000 // MINUTE_MS * MINUTE_MS + MINUTE_MS


def _columns(events: list) -> tuple:
    return tuple(list(column) for column in zip(*events))


class StandingReviews(FoldReviews):
    """The answers as they stand now: those applied, then the waiting events on top of them.

    After new events a session tells all its positions, at most ``images`` rows: an answer, or a delete where an
    answer stood before. Waiting events are applied for good as in the class above, so an event that still
    comes in time takes its place and the answers are told again.
    """

    def init(self, handle) -> None:
        super().init(handle)
        self.shown = handle.getValueState(
            "shown", "number bigint, version bigint, agreed array<boolean>, level array<int>, at array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = list(self._take(rows, timerValues.getCurrentWatermarkInMs()))
        number, version, answers = self._shown()
        now = self._follow(answers, changes)
        told = list(now)
        walk = len(told), self.done
        for events in self._waiting_events() if not self.done else ():
            walk = self._walk(told, events, walk[1])
        version += 1
        yield self._rows(key, told, number, version)
        self._keep(len(told), version, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cleared = False
        changes = list(self._expire(timerValues.getCurrentWatermarkInMs()))
        if self.cleared:
            self.shown.clear()
            return
        number, version, answers = self._shown()
        self._keep(number, version, self._follow(answers, changes))
        yield from ()

    def _clear(self) -> None:
        super()._clear()
        self.cleared = True

    def _shown(self) -> tuple[int, int, list]:
        number, version, *columns = self.shown.get() or (0, 0)
        return number, version, list(zip(*columns))

    def _keep(self, number: int, version: int, answers: list) -> None:
        self.shown.update((number, version, *(_columns(answers) if answers else ([], [], []))))

    @staticmethod
    def _follow(answers: list, changes: list[list[tuple]]) -> list:
        """The applied answers after some changes, which stay tuples: a frame for each session would cost more than the fold."""
        for part in changes:
            for _, op, _, agreed, level, at in part:
                if op == "answer":
                    answers.append((agreed, None if pd.isna(level) else int(level), at))
                elif op == "retract":
                    answers.pop()
        return answers

    def _walk(self, told: list, events: list, done: bool) -> tuple[int, bool]:
        for us, _, action, level in events:
            if done:
                break
            if action == "quit":
                done = True
            elif action == "back":
                if told:
                    told.pop()
            else:
                told.append((action == "agree", None if action == "agree" else level, us))
                done = len(told) >= self.images
        return len(told), done

    @staticmethod
    def _rows(key, told: list, before: int, version: int) -> pd.DataFrame:
        gone = max(0, before - len(told))
        n = len(told) + gone
        agreed, level, at = zip(*told, *[(None, None, None)] * gone) if n else ((), (), ())
        moments = np.array([np.iinfo(np.int64).min if us is None else us for us in at], dtype="int64").view("datetime64[us]")
        return pd.DataFrame({
            "session": [key[0]] * n, "image_index": np.arange(n), "op": pd.Series(["answer"] * len(told) + ["delete"] * gone, dtype=object),
            "was_correct": pd.array(agreed, dtype="boolean"),
            "corrected_level": pd.array([None if pd.isna(v) else int(v) for v in level], dtype="Int32"),
            "answered_at": moments.astype("datetime64[ns]"), "step": np.full(n, version)})


STANDING = ("session bigint, image_index bigint, op string, was_correct boolean, corrected_level int, "
            "answered_at timestamp, step bigint")


def _milliseconds(events: DataFrame, span: str | None) -> int | None:
    if span is None:
        return None
    seconds = events.sparkSession.range(1).select(F.expr(
        f"unix_micros(timestamp '1970-01-02 00:00:00' + interval {span}) - unix_micros(timestamp '1970-01-02 00:00:00')")).first()[0]
    return seconds // 1000


def _folded(events: DataFrame, processor: type[FoldReviews], schema: str, images: int, late: str, forget: str | None, mode: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("session").transformWithStateInPandas(
        statefulProcessor=processor(images, _milliseconds(events, forget)), outputStructType=schema, outputMode=mode, timeMode="EventTime")


def fold_reviews_stream(events: DataFrame, images: int = 12, late: str = "15 minutes", forget: str | None = "1 day") -> DataFrame:
    """Changes to the standing answers: ``answer``, ``retract``, or a ``late`` event.

    ``events`` as for the batch fold. Run it inside ``stream_settings``; the changes
    of a session carry rising step numbers, see ``standing_answers``. With ``forget`` an ended session leaves no state
    once the watermark is that far past its last event; without, an id may never be used again.
    """
    return _folded(events, FoldReviews, CHANGES, images, late, forget, "Append")


def standing_reviews_stream(events: DataFrame, images: int = 12, late: str = "15 minutes", forget: str | None = "1 day") -> DataFrame:
    """The answers as they stand now, events that still wait for the watermark included: for ``upsert_to_table`` with
    keys ``session, image_index`` and order ``step``."""
    return _folded(events, StandingReviews, STANDING, images, late, forget, "Update")


class ReviewSessions(StatefulProcessor):
    """Sessions of a reviewer as they are now, those still open included.

    State holds the sessions that the watermark has not closed. New events are cut into runs without a pause, and merged
    with them; changed sessions are told, and a start that went into an earlier session is deleted. An
    event whose session the watermark would have closed already is left out, as in the appending stream.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState(
            "open", "version bigint, started array<bigint>, last array<bigint>, total array<bigint>, correct array<bigint>")

    def _load(self) -> tuple[int, list[tuple]]:
        if not self.open.exists():
            return 0, []
        version, *columns = self.open.get()
        return version, list(zip(*columns))

    def _save(self, version: int, sessions: list[tuple]) -> None:
        if sessions:
            self.open.update((version, *_columns(sessions)))
            self.handle.registerTimer(min(last for _, last, _, _ in sessions) // 1000 + self.gap + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, before = self._load()
        passed, pause = timerValues.getCurrentWatermarkInMs() * 1000, self.gap * 1000
        now = before
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            right = part["was_correct"].to_numpy()
            fine = at + pause > passed
            order = np.argsort(at[fine], kind="stable")
            at, right = at[fine][order], right[fine][order].astype(bool)
            if not len(at):
                continue
            cut = np.flatnonzero(np.concatenate([[True], np.diff(at) > pause]))
            stop = np.concatenate([cut[1:], [len(at)]])
            runs = list(zip(at[cut].tolist(), at[stop - 1].tolist(), (stop - cut).tolist(), np.add.reduceat(right.astype(int), cut).tolist()))
            now = self._merged(sorted(now + runs), pause)
        told = [s for s in now if s not in set(before)]
        gone = {s[0] for s in before} - {s[0] for s in now}
        if told or gone:
            version += 1
            yield self._rows(key, told, sorted(gone), version, pause)
        self._save(version, now)

    @staticmethod
    def _merged(sessions: list[tuple], pause: int) -> list[tuple]:
        out: list[tuple] = []
        for started, last, total, correct in sessions:
            if out and started <= out[-1][1] + pause:
                a, b, n, k = out[-1]
                out[-1] = (a, max(b, last), n + total, k + correct)
            else:
                out.append((started, last, total, correct))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, sessions = self._load()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._save(version, [s for s in sessions if s[1] + self.gap * 1000 >= passed])
        yield from ()

    @staticmethod
    def _rows(key, told: list, gone: list, version: int, pause: int) -> pd.DataFrame:
        rows = [(a, b + pause, n, k, "session") for a, b, n, k in told] + [(a, None, None, None, "delete") for a in gone]
        out = pd.DataFrame(rows, columns=["started_at", "ends_at", "total", "correct", "op"])
        out.insert(0, "reviewer", key[0])
        out["step"] = version
        for c in ("started_at", "ends_at"):
            out[c] = pd.to_datetime(out[c].astype("Int64"), unit="us")
        for c in ("total", "correct"):
            out[c] = out[c].astype("Int64")
        return out

    def close(self) -> None:
        pass


def review_sessions_now(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions as they are now, the open ones included: for ``upsert_to_table`` with keys ``reviewer, started_at``
    and order ``step``. ``events`` has ``reviewer``, ``ts`` and ``was_correct``; run it inside ``stream_settings``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("reviewer").transformWithStateInPandas(
        statefulProcessor=ReviewSessions(_milliseconds(events, gap)), outputMode="Update", timeMode="EventTime",
        outputStructType="reviewer bigint, started_at timestamp, ends_at timestamp, total bigint, correct bigint, op string, step bigint")


def standing_answers(changes: DataFrame) -> DataFrame:
    """The answers that stand after all changes, one per session and image."""
    last = changes.where("op <> 'late'").groupBy("session", "image_index").agg(
        F.max_by(F.struct("op", "was_correct", "corrected_level", "at"), "step").alias("c"))
    return last.where("c.op = 'answer'").select(
        "session", "image_index", "c.was_correct", "c.corrected_level",
        F.col("c.at").cast("timestamp_ntz").alias("answered_at"))
