"""Ranked lists: first-wins merging, round robin, tiers and quotas, fusion of rankings.

A ranked list is a table with an explicit rank; ties are settled by path.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key; the limit is pushed below the shuffle's sort (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_wins(df: DataFrame, keys: Sequence[str], items: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per key and item the first row in list order."""
    w = Window.partitionBy(*keys, *items).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def unique_rank(df: DataFrame, keys: Sequence[str], items: Sequence[str], order: Sequence[Column], top: int, rank: str = "rank") -> DataFrame:
    """First-wins, malformed items (null parts) dropped, numbered anew, cut at ``top``."""
    whole = df.dropna(subset=list(items))
    return top_k(first_wins(whole, keys, items, order), keys, order, top, rank)


def merge_ranks(lists: Sequence[DataFrame], keys: Sequence[str], items: Sequence[str], rank: str, top: int, head: int | None = None) -> DataFrame:
    """Lists one after the other, every item where it first occurs, cut at ``top``.

    ``head`` limits the first list; its tail then follows after all others.
    """
    parts = []
    for i, d in enumerate(lists):
        seg = F.lit(i) if head is None or i else F.when(F.col(rank) <= head, F.lit(0)).otherwise(F.lit(len(lists)))
        parts.append(d.select(*keys, *items, seg.alias("__list"), F.col(rank).alias("__pos")))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return unique_rank(merged, keys, items, [F.col("__list"), F.col("__pos")], top, rank).drop("__list", "__pos")


def round_robin(df: DataFrame, keys: Sequence[str], group: Sequence[str], order: Sequence[Column], top: int, cap: Column | int | None = None, by_score: Column | None = None, rank: str = "rank") -> DataFrame:
    """One row of each group in turn, up to ``cap`` per group and ``top`` in all.

    Groups take turns in the order of their first row, or of ``by_score`` (best first).
    """
    own = Window.partitionBy(*keys, *group)
    turn = df
    if by_score is not None:
        turn = turn.withColumn("__best", F.max(by_score).over(own))
    # No group gives more than ``top`` rows, so that is cut before the key's rows come together.
    turn = turn.withColumn("__turn", F.row_number().over(own.orderBy(*order))).filter(F.col("__turn") <= top)
    if cap is not None:
        turn = turn.filter(F.col("__turn") <= cap)
    turn = turn.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    turn = turn.withColumn("__first", F.min("__pos").over(own))
    sort = [F.col("__turn"), *([F.col("__best").desc()] if by_score is not None else []), F.col("__first")]
    return top_k(turn, keys, sort, top, rank).drop("__pos", "__turn", "__first", "__best")


def tiered(tiers: Sequence[DataFrame], keys: Sequence[str], items: Sequence[str], order: Sequence[str], top: int) -> DataFrame:
    """Tiers one after the other, each sorted by (score descending, item), every item once."""
    parts = [t.withColumn("__tier", F.lit(i)) for i, t in enumerate(tiers)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    sort = [F.col("__tier"), *[F.col(c).desc() if c == "score" else F.col(c) for c in order]]
    return unique_rank(merged, keys, items, sort, top).drop("__tier")


def source_quota(exact: DataFrame, pool: DataFrame, key: str, top: int) -> DataFrame:
    """(key, path, rank): exact counterparts, then one unseen candidate of every source, then the best of the rest.

    ``exact`` and ``pool`` have key, source_path, path, score, and
    ``source_order``. The choice of a source depends on those before it, so a key's bounded
    candidate pool (top n per source) is handled as one group. The result has
    max(top, number of sources) rows at most.
    """
    schema = f"{key} {dict(pool.dtypes)[key]}, path string, rank int"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source_order", "score", "path"], ascending=[True, False, True])
        taken = dict.fromkeys(pdf.loc[pdf["exact"], "path"])  # in order, each once
        rest = pdf[~pdf["exact"]]
        sources = pdf["source_order"].unique()
        for s in sources:
            unseen = next((p for p in rest.loc[rest["source_order"] == s, "path"] if p not in taken), None)
            if unseen is not None:
                taken[unseen] = None
        taken.update(dict.fromkeys(rest.sort_values(["score", "path"], ascending=[False, True])["path"]))
        kept = list(taken)[: max(top, len(sources))]
        return pd.DataFrame({key: pdf[key].iloc[0], "path": kept, "rank": range(1, len(kept) + 1)})

    both = exact.withColumn("exact", F.lit(True)).unionByName(pool.withColumn("exact", F.lit(False)))
    return both.groupBy(key).applyInPandas(choose, schema)


def fuse(rankings: Sequence[tuple[DataFrame, Column]], keys: Sequence[str], items: Sequence[str], top: int, out: str = "score") -> DataFrame:
    """Sums of per-list contributions of every item, best ``top`` per key by (score descending, items)."""
    merged = None
    for d, part in rankings:
        p = d.select(*keys, *items, part.alias("__part"))
        merged = p if merged is None else merged.unionByName(p)
    total = merged.groupBy(*keys, *items).agg(F.round(F.sum("__part"), 9).alias(out))
    return top_k(total, keys, [F.col(out).desc(), *[F.col(i) for i in items]], top)


def reciprocal(rank: Column, weight: float, shift: float) -> Column:
    return F.lit(weight) / (F.lit(shift) + rank)


def scaled(score: Column, keys: Sequence[str]) -> Column:
    """A score over its key's maximum; 0 where that is 0."""
    return F.coalesce(F.try_divide(score, F.max(score).over(Window.partitionBy(*keys))), F.lit(0.0))


def blocks_of(df: DataFrame, keys: Sequence[str], radius: int = 8, bucket: int = 25) -> DataFrame:
    """Candidate lines as blocks: by symbol, else by line bucket; .50 best + .22 mean + .18 modules + .10 min(n, 12) / 12."""
    name = F.coalesce(F.when(F.col("symbol") != "", F.col("symbol")), F.concat(F.lit("line_bucket_"), F.floor(F.col("line") / bucket).cast("string")))
    per = df.withColumn("block", name).groupBy(*keys, "path", "block").agg(
        F.max("score").alias("best"), F.avg("score").alias("mean"), F.count_distinct("module").alias("modules"), F.count(F.lit(1)).alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi")
    )
    score = 0.50 * F.col("best") + 0.22 * F.col("mean") + 0.18 * F.col("modules") + 0.10 * F.least(F.col("n"), F.lit(12)) / 12
    return per.select(*keys, "path", "block", F.greatest(F.col("lo") - radius, F.lit(1)).alias("start"), (F.col("hi") + radius).alias("end"), F.round(score, 6).alias("block_score"), "modules", "n")


def probe_lines(blocks: DataFrame, candidates: DataFrame, keys: Sequence[str], stride: int = 5) -> DataFrame:
    """Lines to look at besides the candidates: every ``stride``-th of a block, and its middle."""
    probes = blocks.select(*keys, "path", "block", F.explode(F.array_union(F.sequence(F.col("start"), F.col("end"), F.lit(stride)), F.array(F.floor((F.col("start") + F.col("end")) / 2).cast("int")))).alias("line"))
    return probes.join(candidates.select(*keys, "path", "line").distinct(), [*keys, "path", "line"], "left_anti")
