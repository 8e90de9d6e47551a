"""Streaming twins that read a table's files as a stream and run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path


def state_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a query's checkpoint and output, in the shared folder."""
    return new_path(spark, name)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, in its own schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def finished(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs ``stream`` over what is there now; append goes to files, complete results to the last batch's table."""
    spark = stream.sparkSession
    place = state_dir(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{place}/out")

        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, bucket, n) by event time."""
    at = F.col("ts").cast("timestamp")
    counts = stream_of(spark, path).groupBy("event_type", F.window(at, "1 hour")["start"].cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    return finished(counts, "hourly-counts", "complete")
