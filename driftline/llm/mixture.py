"""Mixing sources to target shares, by a minimum-cost flow.

A text may belong to several sources (it occurs again under another id). Texts
are aggregated by the set of sources they belong to, the membership pattern;
only these sums reach the driver (at most as many as sets of listed sources
occur). Tokens flow from patterns
to source quotas; using a pattern's texts for the r-th time costs r - 1, so
repetition is convex and comes last. As these are the only costs, cheapest
paths are those that begin at the pattern with the fewest uses: the flow of least
cost is a maximum flow over first uses, raised to one over second uses, and so
on. Paths run between sources over whole columns of patterns. The flow then picks documents: a
pattern's texts are laid out in seeded order by their tokens, every source
takes a stretch of that line, which starts over at its end, and a text is used
as often as stretches cover its start. No text is used for a source more than
its ``max_repeats`` times, as no stretch is longer than that many lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.runtime import col, cut

Patterns = list[tuple[tuple[str, ...], int]]
#: Most rows of the plan that are broadcast; a longer plan is joined by shuffle.
BROADCAST_ROWS = 100_000


def _spend(limit: np.ndarray, amount: int) -> np.ndarray:
    """``amount`` taken from the first places of ``limit``."""
    taken = np.minimum(np.cumsum(limit), amount)
    return np.diff(taken, prepend=0)


class Flow:
    """Tokens of patterns flowing to sources: ``flow`` and ``room`` are (patterns, sources), ``free`` what a pattern may still give."""

    def __init__(self, patterns: Patterns, quotas: dict[str, int], repeats: dict[str, int]) -> None:
        self.names = sorted(quotas)
        place = {n: i for i, n in enumerate(self.names)}
        self.tokens = np.array([t for _, t in patterns], dtype=np.int64)
        self.room = np.zeros((len(patterns), len(self.names)), dtype=np.int64)
        self.uses = np.zeros(len(patterns), dtype=np.int64)
        for p, (members, tokens) in enumerate(patterns):
            for n in members:
                if n in place:
                    self.room[p, place[n]] = tokens * repeats[n]
                    self.uses[p] = max(self.uses[p], repeats[n])
        self.flow = np.zeros_like(self.room)
        self.free = np.zeros(len(patterns), dtype=np.int64)
        self.need = np.array([quotas[n] for n in self.names], dtype=np.int64)

    def _shifts(self, a: int) -> np.ndarray:
        """How much of source ``a``'s flow could go to each other source instead."""
        held = np.flatnonzero(self.flow[:, a])
        out = np.minimum(self.flow[held, a][:, None], self.room[held]).sum(axis=0)
        out[a] = 0
        return out

    def raise_to_maximum(self) -> None:
        while True:
            enters = np.minimum(self.free[:, None], self.room).sum(axis=0)
            via = {int(a): None for a in np.flatnonzero(enters)}
            queue, at = list(via), 0
            end = next((a for a in queue if self.need[a]), None)
            while end is None and at < len(queue):
                a, at = queue[at], at + 1
                for b in np.flatnonzero(self._shifts(a)).tolist():
                    if b not in via:
                        via[b] = a
                        queue.append(b)
                        if self.need[b]:
                            end = b
                            break
            if end is None:
                return
            path = [end]
            while via[path[-1]] is not None:
                path.append(via[path[-1]])
            hops = list(zip(path[1:], path[:-1], strict=True))  # (from, to), the last hop first
            amount = int(min(self.need[end], enters[path[-1]], *[self._shifts(a)[b] for a, b in hops]))
            self.need[end] -= amount
            for a, b in hops:
                moved = _spend(np.minimum(self.flow[:, a], self.room[:, b]), amount)
                self.flow[:, a] -= moved
                self.room[:, a] += moved
                self.flow[:, b] += moved
                self.room[:, b] -= moved
            first = path[-1]
            given = _spend(np.minimum(self.free, self.room[:, first]), amount)
            self.flow[:, first] += given
            self.room[:, first] -= given
            self.free -= given

    def short(self) -> np.ndarray:
        """The sources whose flow all together is the most they can get, as no other pattern reaches an unfilled one."""
        found = set(np.flatnonzero(self.need).tolist())
        while True:
            more = {a for a in range(len(self.names)) if a not in found and self._shifts(a)[list(found)].any()}
            if not more:
                return np.array(sorted(found), dtype=int)
            found |= more


def _quotas(shares: dict[str, float], total: int) -> dict[str, int]:
    return {n: int(s * total) for n, s in shares.items()}


def least_cost(patterns: Patterns, quotas: dict[str, int], repeats: dict[str, int]) -> Flow:
    """A maximum flow to the quotas of least cost."""
    f = Flow(patterns, quotas, repeats)
    for use in range(1, int(f.uses.max(initial=0)) + 1):
        f.free += np.where(f.uses >= use, f.tokens, 0)
        f.raise_to_maximum()
    return f


def plan(patterns: Patterns, shares: dict[str, float], repeats: dict[str, int], total: int) -> list[tuple[str, str, int, int, int]]:
    """(pattern, source, from, to, length): the stretch of the pattern's line that a source takes."""
    f = least_cost(patterns, _quotas(shares, total), repeats)
    ends = np.cumsum(f.flow, axis=1)
    return [("\0".join(patterns[p][0]), f.names[s], int(ends[p, s] - f.flow[p, s]), int(ends[p, s]), patterns[p][1]) for p, s in zip(*(x.tolist() for x in np.nonzero(f.flow)), strict=True)]


def balanced_total(patterns: Patterns, shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source that has texts can reach its share within its repeats.

    From above: where a total can't be reached, the sources that fall short together get the most
    they can, which gives the next lower total. Each step fixes another set of sources.
    """
    own = dict.fromkeys(shares, 0)
    for names, tokens in patterns:
        for n in names:
            if n in own:
                own[n] += tokens * repeats[n]
    present = {n: s for n, s in shares.items() if own[n]}
    total = int(min((own[n] / s for n, s in present.items()), default=0))
    while total:
        f = Flow(patterns, _quotas(present, total), repeats)
        f.free = f.tokens * f.uses
        f.raise_to_maximum()
        if not f.need.any():
            break
        short = f.short()
        total = min(total - 1, int(f.flow[:, short].sum() / sum(present[f.names[i]] for i in short)))
    return max(total, 0)


def mix(
    docs: DataFrame, targets: DataFrame, record: str, text: str, source: str, tokens: str, *,
    total_tokens: int | None = None, seed: int = 7,
) -> DataFrame:
    """(record, source, uses, tokens): the documents of the mixture and how often each is used.

    ``targets`` has source, target_share, max_repeats, one row per source (it
    is a configuration table: collected). The mixture aims at ``total_tokens``,
    by default the largest total at which every source that has texts reaches
    its share. Documents of
    unlisted or null sources, and null or empty texts, take no part. A text
    that occurs repeatedly in a source counts once there (smallest record). A
    source without documents, a null share or zero repeats gets nothing; where a quota
    can't be filled within the repeats the rest stays unfilled. Empty in, empty out.
    """
    spark = docs.sparkSession
    wanted = {r["source"]: r for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    shares = {k: float(r["target_share"]) for k, r in wanted.items()}
    repeats = {k: int(r["max_repeats"]) for k, r in wanted.items()}
    listed = docs.filter(col(source).isin(list(wanted)) & (F.length(col(text)) > 0) & (col(tokens) > 0))
    own = listed.groupBy(F.md5(F.encode(col(text), "UTF-8")).alias("k"), col(source).alias("s")).agg(F.min(col(record)).alias("r"), F.max(col(tokens)).alias("t"))
    # One row per distinct text; its sources are at most those of the target table.
    texts = cut(own.groupBy("k").agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct("s", "r"))).alias("m")).withColumn("p", F.array_join(F.transform("m", lambda x: x["s"]), "\0")))
    by_pattern = texts.groupBy("p").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    n_texts = sum(r["n"] for r in by_pattern)
    patterns = sorted((tuple(r["p"].split("\0")), int(r["t"])) for r in by_pattern)
    rows = plan(patterns, shares, repeats, total_tokens if total_tokens is not None else balanced_total(patterns, shares, repeats))
    stretches = spark.createDataFrame(rows, "p string, s string, a bigint, b bigint, len bigint")
    # Exact running sums in seeded order: sums of hash buckets first, then within a bucket.
    buckets = max(64, -(-n_texts // 50_000))
    placed = texts.withColumn("h", F.xxhash64("k", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sizes = placed.groupBy("p", "bucket").agg(F.sum("t").alias("bt"))
    before = Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("p", "bucket").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("p", "bucket", F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("base"))
    at = placed.join(offsets, ["p", "bucket"]).withColumn("c", F.col("base") + F.coalesce(F.sum("t").over(inside), F.lit(0)))
    used = at.join(F.broadcast(stretches) if len(rows) <= BROADCAST_ROWS else stretches, "p").withColumn("uses", (F.ceil((F.col("b") - F.col("c")) / F.col("len")) - F.ceil((F.col("a") - F.col("c")) / F.col("len"))).cast("int"))
    mine = F.get(F.filter("m", lambda x: x["s"] == F.col("s")), 0)["r"]
    return used.filter("uses > 0").select(mine.alias(record), F.col("s").alias("source"), "uses", F.col("t").cast("bigint").alias("tokens"))


def reached(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_uses) of every listed source."""
    per = mixture.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").na.fill(0, ["tokens", "documents", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy())  # as many rows as the target table
    return joined.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "tokens", "documents", "most_uses")
