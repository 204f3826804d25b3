"""Parameters that follow the reviews as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadframes.operators.feedback import add_sums, feedback_sums, params_from_sums


def online_params(reviews: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Add each micro-batch to running sums, from which ``latest_params`` follow.

    Old reviews are not read again. The sums of all batches so far are one row with
    the batch number; odd and even batches take turns with two places. So a batch
    that is repeated after a failure starts from the row of the batch before it, and
    is not counted twice.
    """
    def learn(batch: DataFrame, batch_id: int) -> None:
        sums = feedback_sums(batch)
        if batch_id > 0:
            before = _stored(batch.sparkSession, sink, batch_id - 1).where(F.col("batch") == batch_id - 1)
            if before.isEmpty():
                raise ValueError(f"the sums of batch {batch_id - 1} are missing in {sink}")
            sums = add_sums(sums.unionByName(before.drop("batch")))
        sums.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(_place(sink, batch_id))

    return (
        reviews.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def _place(sink: str, batch_id: int) -> str:
    return f"{sink}/{'odd' if batch_id % 2 else 'even'}"


def _stored(spark: SparkSession, sink: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(_place(sink, batch_id))


def latest_params(spark: SparkSession, sink: str, **options) -> DataFrame:
    """The parameters after the last batch; ``options`` as for ``params_from_sums``."""
    sums = _stored(spark, sink, 0)
    try:
        sums = sums.unionByName(_stored(spark, sink, 1))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return params_from_sums(sums.orderBy(F.desc("batch")).limit(1), **options)
