"""Finite-state machines over the ordered rows of each group, decoded in parallel.

A symbol is a map from the state before it to the state after it, and maps compose associatively. So
rows are dealt to ranges of the whole order, also inside a group, and each range composes its own
maps by doubling steps; only the group that a range begins inside is worked out for every state that may
enter it. One small row for each range tells the entering states, and these pick the outputs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadframes.session import materialise

cloudpickle.register_pickle_by_value(sys.modules["roadframes"])

#: What a range of rows tells of its first and its last group.
SUMMARY = T.StructType([
    *(T.StructField(name, T.StringType()) for name in ("first_key", "last_key")),
    *(T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("first_map", "last_map"))])


@dataclass(frozen=True)
class Machine:
    """``moves`` maps (state, symbol) to (next state, output or None). A symbol without a move changes nothing."""

    start: str
    moves: dict[tuple[str, str], tuple[str, tuple | None]]

    def tables(self) -> tuple[list[str], dict[str, int], np.ndarray, np.ndarray, list[tuple | None]]:
        """States (the start first), symbol codes, next states and outputs by (symbol, state), and the outputs."""
        states = [self.start] + sorted({s for s, _ in self.moves} | {s for s, _ in self.moves.values()} - {self.start})
        states = list(dict.fromkeys(states))
        symbols = {x: k for k, x in enumerate(sorted({x for _, x in self.moves}))}
        outputs: list[tuple | None] = [None, *dict.fromkeys(o for _, o in self.moves.values() if o is not None)]
        to = np.tile(np.arange(len(states), dtype=np.int32), (len(symbols) + 1, 1))
        out = np.zeros_like(to)
        for (state, symbol), (then, output) in self.moves.items():
            at = symbols[symbol], states.index(state)
            to[at], out[at] = states.index(then), outputs.index(output)
        return states, symbols, to, out, outputs


def compose_prefixes(maps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Row by row the composition of all maps from the row's group's first one on; ``begins`` marks first rows."""
    maps, place = maps.copy(), np.arange(len(maps))
    inside = place - np.maximum.accumulate(np.where(begins, place, 0))
    step = 1
    while step <= inside.max(initial=0):
        late = np.flatnonzero(inside >= step)
        maps[late] = np.take_along_axis(maps[late], maps[late - step], axis=1)
        step *= 2
    return maps


def _codes(column: pa.Array, symbols: dict[str, int]) -> np.ndarray:
    encoded = column.dictionary_encode(null_encoding="encode")
    known = np.array([symbols.get(x, len(symbols)) for x in encoded.dictionary.to_pylist()] or [0], dtype=np.int64)
    return known[encoded.indices.to_numpy(zero_copy_only=False)]


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows whose keys differ from those of the row before; the first row does not count."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        at = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= at[1:] != at[:-1]
    return out


def decode(df: DataFrame, machine: Machine, keys: Sequence[str], order: Sequence[str], symbol: str, outputs: dict[str, str]) -> DataFrame:
    """Run the machine over each group of ``keys`` in ``order``, which must be unique inside a group.

    ``outputs`` names the fields of the machine's outputs and their types; they are added to every row, NULL where the
    machine says nothing. A NULL symbol changes nothing; rows with NULL keys are groups like others.
    """
    _, symbols, to, out, told = machine.tables()
    size = to.shape[1]
    identity = np.arange(size, dtype=np.int32)
    columns = df.columns
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    schema = T.StructType([*fields, T.StructField("_part", T.IntegerType()), T.StructField("_first", T.BooleanType()),
                           T.StructField("_out", T.ArrayType(T.IntegerType())), T.StructField("_summary", SUMMARY)])

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * size, pa.int32()), pa.array(a.ravel(), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first_key = key = first_map = None
        carried, only = identity, True
        kinds = None
        summary = pa.struct([("first_key", pa.string()), ("last_key", pa.string()),
                             ("first_map", pa.list_(pa.int32())), ("last_map", pa.list_(pa.int32()))])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = [c.type for c in batch.columns]
            begins = _changes(batch, keys)
            here = repr([batch.column(k)[0].as_py() for k in keys])
            if first_key is None:
                first_key = key = here
            begins[0] = here != key
            if begins[0]:
                if only:
                    first_map, only = carried, False
                carried = identity
            code = _codes(batch.column(symbol), symbols)
            cut = begins.copy()
            cut[0] = True
            whole = compose_prefixes(to[code], cut)
            starts = np.flatnonzero(cut)
            lead = starts[1] if len(starts) > 1 else n  # rows that go on with the group of the batch before
            whole[:lead] = whole[:lead][:, carried]
            before = np.empty_like(whole)
            before[1:] = whole[:-1]
            before[cut] = identity
            before[0] = carried
            first = np.zeros(n, dtype=bool)
            if only:
                first[:lead] = True
                if lead < n:
                    first_map, only = whole[lead - 1], False
            carried, key = whole[-1], repr([batch.column(k)[n - 1].as_py() for k in keys])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(first), lists(out[code[:, None], before]),
                 pa.nulls(n, summary)], schema.names)
        if kinds is not None:
            told_of = {"first_key": first_key, "last_key": key, "last_map": carried.tolist(),
                       "first_map": (carried if only else first_map).tolist()}
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, k) for k in kinds), pa.array([part], pa.int32()), pa.array([False]), pa.nulls(1, pa.list_(pa.int32())),
                 pa.array([told_of], summary)], schema.names)

    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    made = materialise(ranged.mapInArrow(run, schema), "decoded")
    entering = _entering(made.where("_summary is not null").select("_part", "_summary.*").orderBy("_part"))
    spark = df.sparkSession
    states = spark.createDataFrame(entering, "_part int, _state int")  # at most one row for each range
    rows = made.where("_summary is null").join(F.broadcast(states), "_part", "left")
    state = F.when(F.col("_first"), F.coalesce("_state", F.lit(0))).otherwise(0)
    code = F.get("_out", state)
    choices = {name: F.array(*(F.lit(None if o is None else o[k]).cast(kind) for o in told))
               for k, (name, kind) in enumerate(outputs.items())}
    return rows.select(*columns, *(F.get(choice, code).alias(name) for name, choice in choices.items()))


def _entering(parts: DataFrame) -> list[tuple[int, int]]:
    """States other than the start in which ranges begin, from one row for each range."""
    out, key, state = [], None, 0
    for r in parts.toLocalIterator():
        entering = state if r["first_key"] == key else 0
        if entering:
            out.append((r["_part"], entering))
        state = r["first_map"][entering] if r["first_key"] == r["last_key"] else r["last_map"][0]
        key = r["last_key"]
    return out
