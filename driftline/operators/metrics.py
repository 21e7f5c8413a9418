"""Retrieval metrics: per query, macro and micro, hits at k, weighted merges of partial results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def file_metrics(ranked: DataFrame, truth: DataFrame, query: Sequence[str], item: str, ks: Sequence[int]) -> DataFrame:
    """(query, k, precision, recall, f1, rr) of ranked(query, item, rank) against truth(query, item)."""
    gt = truth.select(*query, item).distinct()
    total = gt.groupBy(*query).agg(F.count(F.lit(1)).alias("gt"))
    hit = ranked.join(gt.withColumn("hit", F.lit(1)), [*query, item], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    at = hit.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    per = at.groupBy(*query, "k").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    grid = total.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    joined = grid.join(per, [*query, "k"], "left").na.fill(0, ["hits", "n"])
    p = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    r = F.col("hits") / F.col("gt")
    return joined.select(*query, "k", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def statement_metrics(ranked: DataFrame, truth: DataFrame, query: Sequence[str], k: int, tolerance: int) -> DataFrame:
    """(query, precision, coverage, f1, rr): predicted (path, line, rank) against ranges (path, start, end) within a tolerance."""
    pred = ranked.filter(F.col("rank") <= k).select(*query, "path", "line", "rank")
    gt = truth.select(*query, "path", "start", "end").distinct()
    close = F.col("line").between(F.col("start") - tolerance, F.col("end") + tolerance)
    pairs = pred.join(gt, [*query, "path"]).filter(close)
    hits = pairs.select(*query, "path", "line", "rank").distinct().groupBy(*query).agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    covered = pairs.select(*query, "path", "start", "end").distinct().groupBy(*query).agg(F.count(F.lit(1)).alias("covered"))
    sizes = gt.groupBy(*query).agg(F.count(F.lit(1)).alias("gt"))
    n = pred.groupBy(*query).agg(F.count(F.lit(1)).alias("n"))
    joined = sizes.join(n, list(query), "left").join(hits, list(query), "left").join(covered, list(query), "left").na.fill(0, ["n", "hits", "covered"])
    p = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    c = F.col("covered") / F.col("gt")
    return joined.select(*query, p.alias("precision"), c.alias("coverage"), _f1(p, c).alias("f1"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def block_metrics(ranked: DataFrame, truth: DataFrame, query: Sequence[str], k: int, tolerance: int) -> DataFrame:
    """(query, precision, coverage, f1, rr) of blocks (path, start, end, rank) against anchored statements (path, anchor) within a tolerance.

    A block is right if it holds one anchor; every statement counts, also several of one anchor (``n`` of them).
    """
    pred = ranked.filter(F.col("rank") <= k).select(*query, "path", "start", "end", "rank")
    gt = truth.groupBy(*query, "path", "anchor").agg(F.count(F.lit(1)).alias("n"))
    pairs = pred.join(gt, [*query, "path"]).filter(F.col("anchor").between(F.col("start") - tolerance, F.col("end") + tolerance))
    right = pairs.groupBy(*query).agg(F.count_distinct("rank").alias("right"), F.min("rank").alias("first"))
    covered = pairs.select(*query, "path", "anchor", "n").distinct().groupBy(*query).agg(F.sum("n").alias("covered"))
    sizes, blocks = gt.groupBy(*query).agg(F.sum("n").alias("gt")), pred.groupBy(*query).agg(F.count(F.lit(1)).alias("blocks"))
    joined = sizes.join(blocks, list(query), "left").join(right, list(query), "left").join(covered, list(query), "left").na.fill(0, ["blocks", "right", "covered"])
    p = F.when(F.col("blocks") > 0, F.col("right") / F.col("blocks")).otherwise(0.0)
    c = F.col("covered") / F.col("gt")
    return joined.select(*query, p.alias("precision"), c.alias("coverage"), _f1(p, c).alias("f1"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def macro(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means of the measures per key; 0 where there is nothing to average."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures], F.count(F.lit(1)).alias("queries"))


def micro(ranked: DataFrame, truth: DataFrame, query: Sequence[str], item: str, ks: Sequence[int]) -> DataFrame:
    """(k, precision, recall, f1, hit_rate, mrr) over all queries that have a truth or a ranking.

    Queries without truth stay out of the sums but count for hit rate and MRR.
    """
    queries = ranked.select(*query).distinct().unionByName(truth.select(*query).distinct()).distinct()
    gt = truth.select(*query, item).distinct()
    sizes = queries.join(gt.groupBy(*query).agg(F.count(F.lit(1)).alias("gt")), list(query), "left").na.fill(0, ["gt"])
    hit = ranked.join(gt.withColumn("hit", F.lit(1)), [*query, item], "left")
    grid = F.explode(F.array(*[F.lit(k) for k in ks]))
    at = hit.withColumn("k", grid).filter(F.col("rank") <= F.col("k"))
    per = at.groupBy(*query, "k").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    all_ = sizes.withColumn("k", grid).join(per, [*query, "k"], "left").na.fill(0, ["hits", "n"])
    judged = F.col("gt") > 0
    out = all_.groupBy("k").agg(
        F.sum(F.when(judged, F.col("hits"))).alias("hits"), F.sum(F.when(judged, F.col("n"))).alias("n"), F.sum("gt").alias("gt"),
        F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )
    p = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("gt") > 0, F.col("hits") / F.col("gt")).otherwise(0.0)
    return out.select("k", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), "hit_rate", "mrr")


def hits_at(records: DataFrame, ranked: DataFrame, keys: Sequence[str], method: str, ks: Sequence[int], worst: int) -> DataFrame:
    """(method, metric, value, n): Hit@k, MRR@max k and mean rank over judgement records; a miss ranks ``worst``.

    ``records`` has one row per judgement with ``keys``; ``ranked`` has keys, method, rank.
    """
    methods = ranked.select(method).distinct()
    grid = records.select(*keys).distinct().join(F.broadcast(methods))  # a handful of method labels
    best = ranked.groupBy(*keys, method).agg(F.min("rank").alias("rank"))
    joined = grid.join(best, [*keys, method], "left")
    top = max(ks)
    rank = F.col("rank")
    values = [(f"Hit@{k}", F.avg(F.when(rank <= k, 1.0).otherwise(0.0))) for k in ks]
    values += [(f"MRR@{top}", F.avg(F.when(rank <= top, 1.0 / rank).otherwise(0.0))), ("MeanRank", F.avg(F.coalesce(rank, F.lit(worst)).cast("double")))]
    wide = joined.groupBy(method).agg(F.count(F.lit(1)).alias("n"), *[v.alias(name) for name, v in values])
    return wide.select(method, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("value")) for name, _ in values])).alias("m")).select(method, "m.metric", "m.value", "n")


def weighted_merge(parts: DataFrame, keys: Sequence[str], measures: Sequence[str], weight: str) -> DataFrame:
    """Means of partial means by their weights; a null measure takes no part in its mean."""
    w = F.col(weight)
    return parts.groupBy(*keys).agg(*[(F.sum(F.col(m) * w) / F.sum(F.when(F.col(m).isNotNull(), w))).alias(m) for m in measures], F.sum(w).alias(weight))


def replace_method(old: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """``old`` with the rows of the methods in ``new`` replaced."""
    return old.join(new.select(method).distinct(), method, "left_anti").unionByName(new)


def pivot_metrics(rows: DataFrame, method: str, metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long metric rows as one row per method."""
    return rows.groupBy(method).pivot(metric, list(names)).agg(F.first(value))
