"""One ranking out of several differently scaled scores, by a walk over ranks.

A walker on an item picks one of the scores at random, proposes an item of the
group uniformly and jumps to it if that score ranks it higher, so that the jump
is uniform over the higher-ranked items and the more likely the more of them
there are; with probability 1 - damping it jumps anywhere instead. Only orders
enter, so no score's range matters. (Were the jump certain whenever a higher
item exists, the few items at the very top of one score would collect that
score's mass, and a single extreme score would decide.) The stationary
distribution is found by power iteration; one step costs a sorted prefix sum
per score. Groups are independent, so all groups of a partition are iterated
together in flat arrays.

Groups beyond ``group_limit`` rows never go to one task. Their exact ranks come
from a range-partitioned sort of the values with prefix-summed counts. At the
stationary point an item's probability follows from its own ranks and, per
score, the mass below its rank; only these mass curves are iterated, at
``BINS`` points a score between which they are interpolated by the exact counts
of items. So a round is one small aggregate, and no two ranks are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.runtime import col, cut, fresh, lookup_salted, partitions

DAMPING = 0.5
STEPS = 60
#: A missing score's rank is the mean of the item's ranks and of this many middle ranks.
PRIOR = 2.0
BINS = 4096
#: How many large groups are walked together: their curves pass through the driver.
WIDE_AT_ONCE = 32


def _runs(group: np.ndarray, values: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending order within groups, first and last place of each place's run of ties)."""
    size = len(group)
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new = np.r_[True, (g[1:] != g[:-1]) | ~(v[1:] - v[:-1] <= slack)]
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return order, starts[run], (np.r_[starts[1:], size] - 1)[run]


def ranks(group: np.ndarray, first: np.ndarray, scores: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Mid-ranks in (0, 1) within the group; a missing one speaks neither for nor against (see ``PRIOR``)."""
    found = []
    for s in scores:
        have = ~np.isnan(s)
        order, lo, hi = _runs(group, s)
        rank = np.empty(len(s))
        rank[order] = (lo + hi) / 2 + 0.5 - first[group[order]]
        found.append(np.where(have, rank / np.maximum(np.bincount(group, weights=have)[group], 1), np.nan))
    known = np.sum([~np.isnan(r) for r in found], axis=0)
    middle = (np.nansum(found, axis=0) + 0.5 * PRIOR) / (known + PRIOR)
    return [np.where(np.isnan(r), middle, r) for r in found]


def walk(group: np.ndarray, scores: Sequence[np.ndarray], damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Stationary probabilities; ``group`` holds 0, 1, ... in ascending order, a NaN score is a missing one."""
    size = len(group)
    if not size:
        return np.zeros(0)
    counts = np.bincount(group)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    n = counts[group].astype(float)
    plans = []
    for r in ranks(group, first, scores):
        order, lo, hi = _runs(group, r, 1e-12)
        start = first[group[order]]
        stay = np.empty(size)
        stay[order] = 1 - (start + counts[group[order]] - 1 - hi) / counts[group[order]]
        plans.append((order, lo, start, stay))
    p = 1.0 / n
    for _ in range(steps):
        into = np.zeros(size)
        for order, lo, start, stay in plans:
            run = np.concatenate(([0.0], np.cumsum(p[order])))
            into[order] += (run[lo] - run[start]) / n[order]
            into += p * stay
        q = damping * into / len(plans) + (1 - damping) / n
        if np.abs(q - p).max() < 1e-13:
            return q
        p = q
    return p


def _walker(key: str, scores: Sequence[str], out: str, damping: float, steps: int, min_items: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            pdf = pd.concat(held, ignore_index=True)
            ids = pd.factorize(pdf[key], use_na_sentinel=False)[0]
            keep = np.bincount(ids)[ids] >= min_items
            pdf, ids = pdf[keep], ids[keep]
            if len(pdf):
                weights = walk(ids, [pd.to_numeric(pdf[s]).to_numpy(float, na_value=np.nan) for s in scores], damping, steps)
                yield pdf.assign(**{out: np.round(weights * np.bincount(ids)[ids], 9)})

    return run


def _below(df: DataFrame, value: str, less: str, equal: str) -> DataFrame:
    """``df`` with the exact numbers of rows of its ``gid`` whose ``value`` is less and equal (null for a null value)."""
    spark = df.sparkSession
    counts = df.filter(col(value).isNotNull()).groupBy("gid", col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # The values of a group, however many, in order over the partitions.
    placed = cut(cut(counts).repartitionByRange(partitions(spark), "gid", "v").withColumn("part", F.spark_partition_id()))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("gid", "part").agg(F.sum("c").alias("pc")).withColumn("base", F.coalesce(F.sum("pc").over(before("gid").orderBy("part")), F.lit(0)))
    here = F.coalesce(F.sum("c").over(before("gid", "part").orderBy("v")), F.lit(0))
    ranked = placed.withColumn("here", here).join(sums.select("gid", "part", "base"), ["gid", "part"])
    ranked = cut(ranked.select(F.struct("gid", "v").alias("__key"), (F.col("base") + F.col("here")).alias(less), F.col("c").alias(equal)))
    keyed = df.withColumn("__key", F.when(col(value).isNotNull(), F.struct("gid", col(value).alias("v"))))
    return cut(lookup_salted(keyed, ranked, "__key", counts=ranked.select("__key", F.col(equal).alias("__n"))).drop("__key"))


def _wide_walk(df: DataFrame, scores: Sequence[str], out: str, damping: float, steps: int, bins: int) -> DataFrame:
    """The walk of large groups: ``df`` has ``gid`` and ``n`` (the group's size) besides; at most ``WIDE_AT_ONCE`` groups."""
    spark = df.sparkSession
    k = len(scores)
    have, less, same, r = ([f"__{x}{i}" for i in range(k)] for x in ("have", "less", "same", "rank"))
    rows = cut(df)
    known = rows.groupBy("gid").agg(*[F.count_if(col(s).isNotNull() & ~F.isnan(col(s))).alias(h) for s, h in zip(scores, have, strict=True)])
    rows = rows.join(F.broadcast(known), "gid")
    for i, s in enumerate(scores):
        rows = _below(rows.withColumn(r[i], F.when(~F.isnan(col(s)), col(s) + 0.0)), r[i], less[i], same[i])
        rows = rows.withColumn(r[i], (F.col(less[i]) + F.col(same[i]) / 2) / F.col(have[i])).drop(less[i], same[i])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    middle = (sum((zero(c) for c in r), F.lit(0.0)) + 0.5 * PRIOR) / (sum((F.col(c).isNotNull().cast("int") for c in r), F.lit(0)) + PRIOR)
    rows = rows.select("*", middle.alias("__middle")).select(*df.columns, *[F.round(F.coalesce(F.col(c), F.col("__middle")), 11).alias(c) for c in r])
    for i in range(k):
        rows = _below(rows, r[i], less[i], same[i])
    at = [F.least(F.floor(F.col(c) * bins / F.col("n")), F.lit(bins - 1)).cast("int") for c in less]
    stay = sum(((F.col(lo) + F.col(eq)) / F.col("n") for lo, eq in zip(less, same, strict=True)), F.lit(0.0))
    rows = cut(rows.select(*df.columns, *less, *[a.alias(c) for a, c in zip(at, r, strict=True)], stay.alias("__stay")))

    def curves(weight: Column, given: DataFrame) -> dict[tuple[int, int], np.ndarray]:
        """The sum of a weight at every bin, by group and score: at most WIDE_AT_ONCE * scores * bins numbers."""
        each = given.select("gid", weight.alias("w"), F.posexplode(F.array(*r)).alias("k", "b"))
        got = each.groupBy("gid", "k", "b").agg(F.sum("w").alias("w")).toPandas()
        found = {}
        for (g, i), part in got.groupby(["gid", "k"]):
            found[int(g), int(i)] = np.zeros(bins)
            found[int(g), int(i)][part["b"].to_numpy()] = part["w"].to_numpy(float)
        return found

    sizes = curves(F.lit(1.0), rows)
    groups = sorted({g for g, _ in sizes})
    mass = {key: n / n.sum() for key, n in sizes.items()}
    start = lambda x: np.r_[0.0, np.cumsum(x)[:-1]]
    done = None
    for _ in range(steps):
        # Below an item: the mass of the bins before its own, and of its own the share of items that stand below it.
        table = spark.createDataFrame(
            [(g, *[x.tolist() for i in range(k) for x in (start(mass[g, i]), mass[g, i] / np.maximum(sizes[g, i], 1), start(sizes[g, i]))]) for g in groups],
            "gid bigint, " + ", ".join(f"{x}{i} array<double>" for i in range(k) for x in ("__base", "__each", "__from")),
        )
        held = rows.join(F.broadcast(table), "gid")
        take = lambda c, i: F.get(F.col(f"{c}{i}"), F.col(r[i]))
        under = sum((take("__base", i) + take("__each", i) * (F.col(less[i]) - take("__from", i)) for i in range(k)), F.lit(0.0))
        p = (damping * under / k + (1 - damping)) / F.col("n") / (1 - damping * F.col("__stay") / k)
        done = held.select(*df.columns, *r, p.alias("__p"))
        new = curves(F.col("__p"), done)
        moved = max(float(np.abs(start(new[key]) - start(mass[key])).max()) for key in mass)
        mass = new
        if moved < 1e-10:
            break
    return done.withColumn(out, F.round(F.col("__p") * F.col("n"), 9)).drop(*r, "__p")


def rank_walk(
    df: DataFrame, group: str, item: Sequence[str], scores: Sequence[str], weight: str = "walk_weight", *,
    min_items: int = 1, group_limit: int = 400_000, damping: float = DAMPING, steps: int = STEPS,
) -> DataFrame:
    """Adds ``weight`` to (group, item, scores): the stationary probability times the group's size.

    Higher is better in every score; 1.0 is the average item. Input rows are one per
    item (merge repeats first). Null and NaN scores are missing ones (see
    :func:`walk`); items without any score stand in the middle. Ties in a score
    stand equally high. Groups with fewer than ``min_items`` rows are left
    out; an empty input gives an empty result; null groups are one group.
    The result has the columns group, item, scores and ``weight`` only, so extra input columns can't clash.
    """
    spark = df.sparkSession
    out = fresh([group, *item, *scores], weight)
    base = df.select(col(group), *[col(c) for c in item], *[col(s).cast("double").alias(s) for s in scores])
    sizes = base.groupBy(col(group)).agg(F.count(F.lit(1)).alias("__size"))
    total, largest = sizes.agg(F.sum("__size"), F.max("__size")).first()
    total, largest = total or 0, largest or 0
    # Rows of a partition are bounded: about 100,000 besides one group of at most group_limit.
    tasks = max(int(spark.sparkContext.defaultParallelism), -(-total // 100_000))
    small, large = base, []
    if largest > group_limit:
        # At most total / group_limit groups: their names and sizes may be held by the driver and broadcast.
        large = [(r[0], r[1]) for r in sizes.filter(F.col("__size") > group_limit).orderBy(F.col("__size").desc()).collect()]
        names = spark.createDataFrame([(g, i, n) for i, (g, n) in enumerate(large)], T.StructType([T.StructField("__big", base.schema[group].dataType), T.StructField("gid", T.LongType()), T.StructField("n", T.LongType())]))
        small = base.join(F.broadcast(names), col(group).eqNullSafe(F.col("__big")), "left_anti")
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())])
    done = (
        small.repartition(tasks, col(group))
        .sortWithinPartitions(col(group), *[col(c) for c in item])
        .mapInPandas(_walker(group, scores, out, damping, steps, min_items), schema)
    )
    for at in range(0, len(large), WIDE_AT_ONCE):
        here = base.toDF(*[f"c{i}" for i in range(len(base.columns))]).join(F.broadcast(names.filter(F.col("gid").between(at, at + WIDE_AT_ONCE - 1))), F.col(f"c{base.columns.index(group)}").eqNullSafe(F.col("__big"))).drop("__big")
        walked = _wide_walk(here, [f"c{base.columns.index(s)}" for s in scores], "w", damping, steps, BINS)
        done = done.unionByName(walked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(base.columns)], F.col("w").alias(out)))
    return done
