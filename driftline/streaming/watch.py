"""Watching later changes as a stream: scored against predictions, appended once, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Events per window and key; rows later than the watermark are left out."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return t.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append"):
    """Handles all that is there in micro-batches and ends; a later run goes on behind it."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q
