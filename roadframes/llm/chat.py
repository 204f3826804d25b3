"""Chat texts for training: canonical turns, one template, escaped texts and a loss mask.

Turns come from ``layouts``. The template marks system, user and assistant turns with control strings, and any other
role (the empty one included) with its name. In roles and texts a backslash is doubled and a control
string gets a backslash after its first sign. No control string begins with a sign that one ends with, so
this can be undone, and no text can open or close a turn. The loss mask covers each assistant
turn's text, without its marks.

A dataset is a folder of Parquet files. Rows are ordered by range over all of conversation, turn and the rows'
own contents, so that a conversation with very many turns is dealt to many tasks. A row is a block: whole turns
of one conversation, up to ``block_points`` code points (one longer turn is a block of its own), with ``part`` and
``block`` giving the order, ``loss`` the masked ranges of the block's code points, and ``whole`` telling that
the block is a whole conversation. Reading back, whole blocks are digested where they lie; only the conversations
cut by a block's or a task's end are shuffled, as blocks, and streamed through a task in order: a digest over a
conversation is made in order by its nature, but at no time is more than a block of it held.

Null texts and roles are empty. Rows of one conversation and turn are ordered by role, then text
(records of several turns by a hash of these, each record's turns together); repeated rows stay. A null
conversation id is a conversation of its own and comes first, as do null turns. Records without a known layout give no turns.
An empty table gives an empty dataset. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.llm.common import bounded_batches, over_batches
from roadframes.llm.layouts import LAYOUTS, Layout, with_turns

#: Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
#: What stands before and after the text of a turn.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
TRAINED = "assistant"
ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
TURN = re.compile("|".join([
    *(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()),
    f"{re.escape(OTHER[0])}(?P<other>.*?){re.escape(OTHER[1])}(?P<text>.*?){re.escape(OTHER[2])}"]), re.DOTALL)
BLOCK = ("conv_id long, part int, block int, whole boolean, n_turns int, text string, "
         "loss array<struct<start: int, stop: int>>")


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the range of its text."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    at = 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn begins at {at}: {text[at : at + 40]!r}")
        if m.lastgroup == "text":
            yield unescape(m["other"]), unescape(m["text"])
        else:
            yield m.lastgroup, unescape(m[m.lastgroup])
        at = m.end()


def chat_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str | None = "turn", record: str | None = None,
               layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, key, source, place, layout, role, text``: turns of records (a column of JSON or structs), or of
    rows that are turns.

    Without ``record`` the row's own conv_id, turn, role and text are the record. ``key`` and ``source`` keep the turns
    of one record together where several records have one conversation and turn; they are 0 for records of one turn.
    """
    order = F.col(turn) if turn else F.lit(0)
    content = F.col(record) if record else F.struct(*(F.col(c) for c in ("conv_id", "turn", "role", "text")))
    keyed = rows.select(F.col(conv_id).cast("long").alias("conv_id"), order.cast("long").alias("turn"), content.alias("record"))
    made = with_turns(keyed, "record", layouts)
    several = F.size("turns") > 1
    made = made.select(
        "conv_id", "turn", F.when(several, F.xxhash64(F.to_json("turns"))).otherwise(0).alias("key"),
        F.when(several, F.monotonically_increasing_id()).otherwise(0).alias("source"), "layout",
        F.posexplode("turns").alias("place", "t"))
    return made.select("conv_id", "turn", "key", "source", "place", "layout", "t.role", "t.text")


class _Block:
    """Turns of a conversation, formatted one after the other."""

    def __init__(self):
        self.texts: list[str] = []
        self.loss: list[dict] = []
        self.points = 0

    def add(self, role: str, text: str) -> None:
        formatted, start, stop = format_turn(role, text)
        if role == TRAINED:
            self.loss.append({"start": self.points + start, "stop": self.points + stop})
        self.texts.append(formatted)
        self.points += len(formatted)


def chat_blocks(turns: DataFrame, block_points: int = 1 << 18) -> DataFrame:
    """The blocks of all conversations, in ranges of ascending conversation and turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()), ("n_turns", pa.int32()),
                        ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, conv_id, block = TaskContext.get().partitionId(), 0, None, None
        done: list[dict] = []
        whole = False  # the first and the last conversation of a part may go on in another one
        size = 0

        def close(now_whole: bool) -> None:
            nonlocal number, size
            done.append({"conv_id": conv_id, "part": part, "block": number, "whole": now_whole, "n_turns": len(block.texts),
                         "text": "".join(block.texts), "loss": block.loss})
            number, size = number + 1, size + block.points

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for own, role, text in zip(*columns, strict=True):
                if block is None:
                    conv_id, block = own, _Block()
                elif own != conv_id:
                    close(whole)
                    conv_id, block, whole = own, _Block(), True
                elif block.points + len(text) > block_points and block.texts:
                    whole = False
                    close(whole)
                    block = _Block()
                block.add(role, text)
                if size >= block_points:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done, size = [], 0
        if block is not None:
            close(False)
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    bounded_batches(turns.sparkSession)
    keys = ["conv_id", "turn", "key", "source", "place", "role", "text", "row"]
    ranged = turns.withColumn("row", F.monotonically_increasing_id())  # deals equal rows to several ranges
    return ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text").mapInArrow(run, BLOCK)


def write_chats(turns: DataFrame, path: str, block_points: int = 1 << 18) -> None:
    chat_blocks(turns, block_points).write.parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, part, block, place, role, text`` parsed back from the formatted texts."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("conv_id", "part", "block", "place", "role", "text")}
        for conv_id, part, block, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "block", "text")), strict=True):
            for place, (role, own) in enumerate(parse_turns(text)):
                for c, v in zip(out, (conv_id, part, block, place, role, own), strict=True):
                    out[c].append(v)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    blocks = spark.read.schema(BLOCK).parquet(path)
    return over_batches(blocks, run, "conv_id long, part int, block int, place int, role string, text string")


class _Digest:
    """What is read back of one conversation, block after block."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, own in parse_turns(text):
            self.turns.update(f"{role}\n{own}\n".encode())
            self.n_turns += 1
        for r in loss:
            own = unescape(text[r["start"] : r["stop"]])
            self.loss.update(own.encode())
            self.loss_chars += len(own)
        self.chars += len(text)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of every conversation in the files."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(text, loss)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    bounded_batches(spark)
    blocks = spark.read.schema(BLOCK).parquet(path).select("conv_id", "part", "block", "whole", "text", "loss")
    cut = blocks.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    digest = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return blocks.where("whole").mapInArrow(run, digest).union(cut.mapInArrow(run, digest))
