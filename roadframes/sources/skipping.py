"""A sidecar beside stored frames that tells which files may hold an id, so that samples and id lists leave the
other files' pixels unread.

``files`` has a row for each file: its rows, its smallest and largest id, and a Bloom filter of its ids in blocks of
bits (an id's hash picks the block and two bits of it). ``ids`` has the narrow pair of id and file, for samples.
Both come from a scan of the id column alone and are hidden from readers of the frames. Files that came after the
index are always read, so an index that is old costs time and no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.operators.sampling import subset
from roadframes.schemas import FRAMES

cloudpickle.register_pickle_by_value(sys.modules["roadframes"])

#: Bits of a block (as many as Spark's bitmap aggregate makes), blocks of a file, and bits of an id.
BLOCK_BITS, BLOCKS, PROBES = 1 << 15, 4, 2
#: Ids that are tested against filters, and files that are read by name; beyond either all files are read and joined.
MOST_IDS, MOST_FILES = 100_000, 10_000
INDEX = "_frame_index"


def _places(key: Column) -> tuple[Column, list[Column]]:
    """The block of an id and its bits there."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(BLOCKS)), [F.pmod(F.shiftrightunsigned(h, 8 + 24 * k), F.lit(BLOCK_BITS)) + 1 for k in range(PROBES)]


def index_frames(spark: SparkSession, path: str, key: str = "frame_id") -> None:
    """Write the sidecar of a frame folder anew. Only the id column is read; ids are BIGINT, and a NULL id is in no filter."""
    ids = spark.read.schema(FRAMES).parquet(path).select(
        F.col(key).cast("bigint").alias("id"), F.col("_metadata.file_path").alias("file"))
    block, bits = _places(F.col("id"))
    by_block = ids.where("id is not null").select("file", block.alias("block"), F.explode(F.array(*bits)).alias("bit")).groupBy("file", "block").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    filters = by_block.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("filter"))  # BLOCKS entries at most
    ranges = ids.groupBy("file").agg(F.count("*").alias("rows"), F.min("id").alias("least"), F.max("id").alias("most"))
    ranges.join(filters, "file", "left").write.mode("overwrite").parquet(f"{path}/{INDEX}/files")
    ids.write.mode("overwrite").parquet(f"{path}/{INDEX}/ids")


def _index(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{INDEX}/{part}")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def files_with(files: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Files of an index that may hold one of the ids: by range, then by filter, a vector of ids at a time."""
    spark = files.sparkSession
    block, bits = _places(F.col("id"))
    placed = spark.createDataFrame([(int(i),) for i in ids], "id bigint").select("id", block.alias("block"), F.array(*bits).alias("bits")).orderBy("id").toArrow()
    want = placed["id"].to_numpy()
    blocks = placed["block"].to_numpy()
    probes = np.array(placed["bits"].to_pylist(), dtype=np.int64).reshape(-1, PROBES) - 1

    def run(batches):
        for batch in batches:
            keep = []
            for least, most, filters in zip(*(batch.column(c).to_pylist() for c in ("least", "most", "filter")), strict=True):
                a, b = (np.searchsorted(want, least), np.searchsorted(want, most, "right")) if least is not None else (0, 0)
                hit = False
                for number, raw in filters or ():
                    table = np.frombuffer(raw, dtype=np.uint8)
                    mine = probes[a:b][blocks[a:b] == number]
                    hit = hit or bool((table[mine >> 3] >> (mine & 7) & 1).all(axis=1).any())
                keep.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column("file").filter(pa.array(keep, pa.bool_()))], ["file"])

    return files.select("file", "least", "most", "filter").mapInArrow(run, "file string")


def _named(uri: str) -> str:
    """One form of a file's address: local ones come with one slash or three."""
    return re.sub(r"^file:/+", "file:/", uri)


def _known(files: DataFrame | None) -> set[str]:
    return set() if files is None else {_named(r["file"]) for r in files.select("file").toLocalIterator()}


def _read(spark: SparkSession, path: str, chosen: list[str], known: set[str]) -> DataFrame:
    """The chosen files, and those that the index does not know."""
    whole = spark.read.schema(FRAMES).parquet(path)
    names = sorted({*map(_named, chosen), *(f for f in map(_named, whole.inputFiles()) if f not in known)})
    if not names:
        return whole.limit(0)
    if len(names) > MOST_FILES:
        return whole.select(*FRAMES.names)
    return spark.read.schema(FRAMES).option("basePath", path).parquet(*map(unquote, names)).select(*FRAMES.names)


def scan_ids(spark: SparkSession, path: str, ids: Sequence[int] | DataFrame, key: str = "frame_id") -> DataFrame:
    """The frames of some ids (numbers, or a table with the id column); files that cannot hold one are not opened.

    An id that is not there gives no row, a NULL one neither.
    """
    if isinstance(ids, DataFrame):
        table = ids.select(F.col(key).cast("bigint")).where(F.col(key).isNotNull()).distinct()
        some = [r[0] for r in table.limit(MOST_IDS + 1).collect()]
    else:
        some = sorted({int(i) for i in ids if i is not None})
        table = None
    files = _index(spark, path, "files")
    if files is None or len(some) > MOST_IDS:
        frames = spark.read.schema(FRAMES).parquet(path).select(*FRAMES.names)
    else:
        chosen = [r["file"] for r in files_with(files, some).limit(MOST_FILES + 1).collect()] if some else []
        frames = _read(spark, path, chosen, _known(files))
    if len(some) <= MOST_IDS // 100:
        return frames.where(F.col(key).isin(some) if some else F.lit(False))
    if table is None:
        table = spark.createDataFrame([(i,) for i in some], f"{key} bigint")
    return frames.join(table, key, "left_semi")


def scan_subset(spark: SparkSession, path: str, n: int, seed: int = 0, key: str = "frame_id") -> DataFrame:
    """``subset`` of stored frames: the rows are chosen among the narrow ids, and only their files are read.

    Without an index the same rows are chosen in the frames themselves.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    ids, files = _index(spark, path, "ids"), _index(spark, path, "files")
    known = _known(files)
    if ids is None or any(f not in known for f in map(_named, frames.inputFiles())) or n > MOST_IDS:
        return subset(frames.select(*FRAMES.names), n, seed, key)
    chosen = subset(ids.withColumnRenamed("id", key), n, seed, key).collect()  # n rows, at most MOST_IDS
    frames = _read(spark, path, sorted({r["file"] for r in chosen}), known)
    return frames.join(F.broadcast(spark.createDataFrame([(r[key],) for r in chosen], f"{key} bigint")), key, "left_semi").select(*FRAMES.names)
