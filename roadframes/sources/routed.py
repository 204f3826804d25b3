"""One write for several outcomes, published when all of it is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_routed(df: DataFrame, outcome: Column, folders: dict[str, str], by: tuple[str, ...] = ("source",)) -> dict[str, int]:
    """Write each row to the folder of its outcome, in one job; returns the rows of each outcome.

    The rows go to a staged folder beside the first one. When all tasks are done the driver renames the
    outcomes' folders to their places, the first one last, so that it is only there when the others are, and
    a job that fails leaves nothing in them. Folders that exist are an error. A row whose outcome
    has no folder fails the job. An outcome without rows gives an empty folder. The rows are counted as they
    are written, without another pass.
    """
    spark = df.sparkSession
    places = {name: folder.rstrip("/") for name, folder in folders.items()}
    main = next(iter(places.values()))
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(main).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in places.values():
        if system.exists(path(folder)):
            raise FileExistsError(folder)
    stage = f"{main}-staged-{uuid.uuid4().hex}"
    known = F.when(outcome.isin(*places), outcome).otherwise(
        F.raise_error(F.concat(F.lit("no folder for outcome "), F.coalesce(outcome, F.lit("NULL")))))
    seen = Observation(f"routed-{uuid.uuid4().hex}")
    rows = df.withColumn("_outcome", known).observe(
        seen, *[F.count_if(F.col("_outcome") == name).alias(name) for name in places])
    try:
        rows.write.partitionBy("_outcome", *by).parquet(stage)
        for name, folder in reversed(places.items()):
            staged, place = path(f"{stage}/_outcome={name}"), path(folder)
            system.mkdirs(place.getParent())
            if not (system.rename(staged, place) if system.exists(staged) else system.mkdirs(place)):
                raise OSError(f"cannot publish {folder}")
    finally:
        system.delete(path(stage), True)
    return {name: seen.get.get(name, 0) for name in places}
