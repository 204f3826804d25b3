"""A sink that keeps the latest version of each key.

Each micro-batch writes its changed rows to a folder of its own, named by the batch; a batch that is
repeated after a failure replaces its own folder and changes nothing. The latest row of a key is the one of
the highest batch, and inside a batch of the highest ``order`` column; a row whose ``op`` is ``delete`` takes its
key away. Every so many batches the folders are folded into a new base, which readers take once it is
whole, and what it replaces is removed afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def numbered_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Whole folders ``name_<number>`` under a path: those whose write was committed."""
    system, at = _system(spark, path)
    out: dict[int, str] = {}
    if not system.exists(at):
        return out
    for entry in system.listStatus(at):
        m = re.fullmatch(r"[a-z]+_(\d+)", entry.getPath().getName())
        folder = f"{path}/{entry.getPath().getName()}"
        if m and system.exists(_system(spark, f"{folder}/_SUCCESS")[1]):
            out[int(m[1])] = folder
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    system, at = _system(spark, path)
    system.delete(at, True)


def _latest(changes: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """The last row of each key; a key's versions are combined in each task before they are shuffled."""
    version = F.struct("_batch", order) if order else F.col("_batch")
    last = F.max_by(F.struct(*changes.columns), version).alias("_row")
    return changes.groupBy(*keys).agg(last).select("_row.*")


def _parts(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame | None, list[int], int]:
    """Base and later batches together, the numbers of these batches, and the base's last batch (-1: no base yet)."""
    bases = numbered_folders(spark, f"{path}/base")
    upto = max(bases, default=-1)
    later = {n: f for n, f in numbered_folders(spark, f"{path}/changes").items() if n > upto}
    folders = [*later.values(), *([bases[upto]] if bases else [])]
    rows = spark.read.schema(f"{schema}, _batch bigint").parquet(*folders) if folders else None
    return rows, sorted(later), upto


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def upsert_to_table(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str | None = None,
                    mode: str = "update", compact_every: int = 20) -> None:
    """Work through all available input and stop; a restart goes on where it was. See ``read_latest``."""
    schema = _ddl(stream)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/changes/batch_{number:012d}")
        rows, later, upto = _parts(spark, path, schema)
        if len(later) < compact_every:
            return
        _latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/base/upto_{later[-1]:012d}")
        for folder in [f for n, f in numbered_folders(spark, f"{path}/changes").items() if n < later[-1]]:
            remove_folder(spark, folder)
        if upto >= 0:
            remove_folder(spark, f"{path}/base/upto_{upto:012d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        store).start().awaitTermination()


def read_latest(spark: SparkSession, path: str, schema: DataFrame | str, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """The latest row of every key that is not deleted, with the stream's columns but ``op`` and ``order``."""
    ddl = schema if isinstance(schema, str) else _ddl(schema)
    rows, _, _ = _parts(spark, path, ddl)
    if rows is None:
        rows = spark.createDataFrame([], f"{ddl}, _batch bigint")
    last = _latest(rows, keys, order)
    if "op" in last.columns:
        last = last.where("op <> 'delete'").drop("op")
    return last.drop("_batch", *([order] if order else []))
