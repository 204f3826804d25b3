"""Best-fit packing of documents into sequences, in bulk-synchronous steps.

1. A document's ids end with an end id; one longer than a sequence is cut into full
   pieces, of which the first is the shorter one.
2. Sorted by length, pieces form runs of equal length, and gaps of open sequences form
   runs of equal size: at most ``capacity`` runs each, whatever the number of documents,
   because both are whole numbers up to ``capacity``. Spark counts the runs.
3. A step sweeps over the runs of pieces from the longest down. All pieces of a run ask for the
   smallest gap that holds them (the successor of their length). Where more pieces ask than
   the gaps hold, those of lower rank get them and the others ask for the next gap; the
   gaps shrink and are sorted in again. Pieces without any gap open sequences, each for
   as many of their run as fit. Steps repeat until no piece is left. The result is that of best-fit decreasing.
4. The sweep gives ranges: pieces of one length and a range of ranks go to a range of
   sequences at one offset. A piece finds its place by its rank in its run.

Ranks are made where the pieces lie: a task numbers its own pieces of each length, and
counts by task and length give the ranks before them. No run is gathered, so a length
that a third of all documents share is no hot key. Only the runs and the ranges, bounded
by the capacity, reach the driver.

Null texts are empty and give the end id alone. Repeated rows are packed as often as they
stand. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadframes.llm.common import bounded_batches, over_batches, texts
from roadframes.llm.tokenids import encoder
from roadframes.session import materialise

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, ordinal long"


def pieces_of(docs: DataFrame, capacity: int, end_id: int, kind: str = "byte", path: str | None = None,
              with_ids: bool = False) -> DataFrame:
    """The pieces of each document, numbered by task and length; with their ids if asked."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tokens = TaskContext.get().partitionId(), encoder(kind, path)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ordinal", "ids")}
            encoded = tokens.encode_all(batch.column("text"))
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids = own + end
                n = len(ids) // 4
                stop = (n - 1) % capacity + 1
                start, number = 0, 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    length = stop - start
                    for c, v in (("doc_id", doc_id), ("piece", number), ("start", start), ("length", length),
                                 ("ids_crc32", zlib.crc32(part)), ("ordinal", int(seen[length]))):
                        out[c].append(v)
                    if with_ids:
                        out["ids"].append(part)
                    seen[length] += 1
                    start, stop, number = stop, stop + capacity, number + 1
            m = len(out["piece"])
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                      *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")),
                      pa.array(np.full(m, task, dtype=np.int32)), pa.array(out["ordinal"], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "ordinal"]
            if with_ids:
                arrays.append(pa.array(out["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        pa.default_memory_pool().release_unused()

    return texts(docs).mapInArrow(cut, PIECE + ", ids binary" * with_ids)


class Gaps:
    """Open sequences by gap: for each gap size a stack of ranges (first sequence, number)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in self.ranges:
                insort(self.sizes, gap)
                self.ranges[gap] = []
            self.ranges[gap].append((first, number))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A range of sequences with the smallest gap of at least this size: the gap, the first sequence, the number."""
        at = bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, number = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap]
            self.sizes.pop(at)
        return gap, first, number


def sweep(runs: dict[int, int], capacity: int) -> np.ndarray:
    """Ranges from the number of pieces of each length: rows of length, first rank, number,
    first sequence, offset; sorted by length and rank.

    What a piece leaves of the smallest gap that holds it is a smaller gap still, so the next piece of its
    run goes there as long as it fits: each sequence of a range takes as many pieces of the run as its gap holds.
    """
    gaps, placed, sequences = Gaps(), [], 0
    for length in sorted(runs, reverse=True):
        rank, left = 0, runs[length]
        while left:
            gap, first, number = gaps.take(length) or (capacity, sequences, left)
            fit = gap // length
            full = min(number, left // fit)
            each = fit if full else left  # the last pieces of a run fill a part of one more gap
            used = full or 1
            for k in range(each):
                placed.append((length, rank, used, first, capacity - gap + k * length))
                rank += used
            left -= used * each
            gaps.add(gap - each * length, first, used)
            if first == sequences:
                sequences += used
            else:
                gaps.add(gap, first + used, number - used)
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 5)


def best_fit_packing(docs: DataFrame, capacity: int = 2048, end_id: int = 0, kind: str = "byte",
                     path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece, and its ``ids`` if asked."""
    pieces = materialise(pieces_of(docs, capacity, end_id, kind, path, with_ids), "pieces")
    counts = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece_runs")
    before = counts.select("task", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    runs = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = sweep(runs, capacity)  # bounded by the capacity, see above
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("ordinal") + F.col("before"))
    most = max([1, *runs.values()]) + 1

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(ranges[:, 0] * most + ranges[:, 1], length * most + rank, "right") - 1
        sequence = ranges[at, 3] + rank - ranges[at, 1]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        columns = [*(batch.column(c) for c in names), pa.array(sequence), pa.array(ranges[at, 4])]
        names += ["sequence_id", "offset"]
        if with_ids:
            columns.append(batch.column("ids"))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
              + ", ids binary" * with_ids)
    return over_batches(ranked, place, schema)
