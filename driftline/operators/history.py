"""Later changes of a repository: snapshot at a time, commits that touch predictions, their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ranking import top_k


def as_of(points: DataFrame, history: DataFrame, key: str, at: str, ts: str, value: str, out: str) -> DataFrame:
    """Each point with the last ``value`` of its key at or before its time; null without one.

    One sort per key over both sides together: the last history value carried
    forward. Nothing is joined, so a busy key costs its rows, not their product.
    """
    p = points.select(key, F.col(at).alias("__t"), F.lit(1).alias("__point"), F.struct(*[F.col(c) for c in points.columns]).alias("__row"), F.lit(None).cast(dict(history.dtypes)[value]).alias("__v"))
    h = history.select(key, F.col(ts).alias("__t"), F.lit(0).alias("__point"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("__t", "__point", "__v").rowsBetween(Window.unboundedPreceding, 0)
    carried = p.unionByName(h).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return carried.filter("__point = 1").select("__row.*", out)


def touching(history: DataFrame, windows: DataFrame, key: str, ts: str, item: str, per_key: int, bin_seconds: int = 86_400) -> DataFrame:
    """History rows within [start, end] of a window of their key, the first ``per_key`` per window, each item once per window.

    The interval condition becomes an equi join on (key, time bin).
    """
    to_bin = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (bin_seconds * 1_000_000))
    w = windows.withColumn("__bin", F.explode(F.sequence(to_bin(F.col("start")), to_bin(F.col("end")))))
    h = history.withColumn("__bin", to_bin(F.col(ts)))
    hits = w.join(h, [key, "__bin"]).filter(F.col(ts).between(F.col("start"), F.col("end"))).drop("__bin")
    first = hits.groupBy(*windows.columns, item).agg(F.min(ts).alias(ts))
    return top_k(first, windows.columns, [F.col(ts), F.col(item)], per_key)


def later_change_score(file_overlap: Column, patch_similarity: Column, message_similarity: Column, hits: Column, predicted: Column) -> Column:
    """.38 files + .37 patch + .15 message + .10 min(1, hits / predicted)."""
    share = F.when(predicted > 0, F.least(F.lit(1.0), hits / predicted)).otherwise(0.0)
    return F.round(0.38 * file_overlap + 0.37 * patch_similarity + 0.15 * message_similarity + 0.10 * share, 6)


def best_changes(scored: DataFrame, source: list[str], date: str, change: list[str], least: float = 0.1, top: int = 10) -> DataFrame:
    """Per source the later changes of score ``least`` or more: order (-score, date, change), ``top`` of them.

    ``scored`` has source, change, date and score; a change without a date comes after those of its score that have one.
    """
    order = [F.col("score").desc(), F.col(date).asc_nulls_last(), *[F.col(c) for c in change]]
    return top_k(scored.filter(F.col("score") >= least), source, order, top)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common values over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
