"""The stream operators, run over the events folder to its end."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from driftline.runtime import shared_folder, table
from driftline.streaming import watch


def windowed_events(spark, d):
    """Events per day and type, counted by a stream with a watermark of 90 days (no row is late)."""
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    schema = ", ".join(f"{n} {t}" for n, t in table(spark, d, "events").dtypes)
    out = f"{folder}/out"
    counts = watch.windowed_counts(watch.read_events(spark, f"{d}/events.parque[t]", schema), "ts", "event_type", "1 day", "90 days")
    watch.run_once(counts, f"{folder}/checkpoint", lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n:08d}"), "update")
    done = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return done.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {
    "windowed_events": (windowed_events, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
}
