"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadframes.session import materialise

#: Rows and bytes of an Arrow batch: texts are long, so a batch is bounded well below a worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless its own bound is lower already."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one: other columns never clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # workers live on, and their memory counts

    return df.mapInArrow(run, schema)


def crc_fold(folds: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % folds


def hash_sample(df: DataFrame, key: str | Sequence[str], rows: int) -> DataFrame:
    """About ``rows`` rows by a hash of their key, all keys if there are fewer: the same keys in every run.

    Each key gives one row, and the share is worked out from the number of different keys, so
    a key on very many rows neither empties the sample nor fills it. A null is a key too."""
    keys = [key] if isinstance(key, str) else list(key)
    drawn = F.xxhash64(F.lit("sample"), *keys)
    n = df.agg(F.approx_count_distinct(drawn, 0.02)).first()[0]
    if n > rows:
        df = df.where(F.pmod(drawn, F.lit(2**31)) < int(2**31 * rows / n))
    return df.dropDuplicates(keys)


def one_text(df: DataFrame, name: str) -> DataFrame:
    """One row of each ``doc_id`` of a bounded set of ids, the one whose text has the smallest hash; stored once.

    Partial aggregates keep an id that stands on very many rows from reaching one task whole."""
    rest = [c for c in df.columns if c != "doc_id"]
    least = F.min(F.struct(F.xxhash64("text").alias("_hash"), *rest)).alias("_row")
    rows = df.groupBy("doc_id").agg(least).select("doc_id", *[F.col("_row")[c].alias(c) for c in rest])
    return spread(rows, name)


def spread(rows: DataFrame, name: str) -> DataFrame:
    """A bounded sample stored and dealt over all cores: adaptive planning would read so few bytes in one task."""
    return materialise(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism), name)


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
