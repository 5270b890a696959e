"""Writing the batches of a live query so that each counts once, however often it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

COMMITS = "batch bigint"
_BATCH = "_batch"


def _committed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMITS).parquet(f"{path}/commits")


def commit_batches(spark: SparkSession, path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """A sink for ``push_stream`` that writes each batch to its own place and then commits it by its number.

    A batch that was committed is not written again. One that failed half-way is overwritten when it is
    repeated, and ``read_committed`` does not see it until it is committed.
    """
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/data/{_BATCH}=-1")
    spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{path}/commits")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if not _committed(own, path).filter(F.col("batch") == number).isEmpty():
            # the query's state is still to be brought up to this batch
            batch.write.format("noop").mode("overwrite").save()
            return
        batch.write.mode("overwrite").parquet(f"{path}/data/{_BATCH}={number}")
        own.range(number, number + 1, 1, 1).select(F.col("id").alias("batch")).write.mode("append").parquet(f"{path}/commits")

    return write


def read_committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches."""
    rows = spark.read.schema(StructType([*schema.fields, StructField(_BATCH, LongType())])).parquet(f"{path}/data")
    commits = _committed(spark, path).select(F.col("batch").alias(_BATCH))
    return rows.join(commits, _BATCH, "left_semi").drop(_BATCH)
