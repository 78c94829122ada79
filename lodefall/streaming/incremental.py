"""Incremental processing: the batch operators over Structured Streaming, run until what is there is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events under `path` with event time."""
    schema = spark.read.parquet(path).schema
    as_pattern = f"{path[:-1]}[{path[-1]}]"  # a stream's path is a folder or a pattern, and the table may be one file
    return spark.readStream.schema(schema).parquet(as_pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so that state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, by: str, time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window and value; late rows beyond the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).count()


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is available, appends it to `path`, and returns the table there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
