"""All similar pairs of set-valued records, over binary sketches.

Every set gets a long code of one-bit minhashes: two sets of Jaccard
similarity J agree in a bit with probability (1 + J) / 2. The code is cut into
segments and records are joined on equal segments; the number of segments is
the least for which a pair at the threshold itself meets in some segment with
probability ``recall`` (1 - (1 - p**w)**m; pairs above the threshold meet more
surely). A joined pair stays if its 192-bit head codes lie within the Hamming
radius that holds ``recall`` of the threshold's binomial distribution, and
last the original sets are compared exactly, so no false pair comes out.

Equal sets are merged into one class first; pairs are found between class
representatives.

Joins are by sorting: Spark estimates a table's size from its file and counts
an array as one element, so that it would take the unfolded segments, some
hundred rows a set, for small and broadcast them through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.runtime import col, cut, lookup_salted

RECALL = 0.99998
HEAD = 192
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def plan(records: int, threshold: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits of a segment, number of segments, Hamming radius of the head code).

    Segments grow with the logarithm of the number of records, which keeps the
    chance meetings per record about constant; the segment count follows from
    the recall.
    """
    agree = (1 + threshold) / 2
    bits = min(28, max(6, round(math.log2(max(records, 2))) - 2))
    segments = math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits)))
    tail, radius = 0.0, HEAD
    while radius > 0:
        tail += math.comb(HEAD, radius) * (1 - agree) ** radius * agree ** (HEAD - radius)
        if tail > (1 - recall) / 4:
            break
        radius -= 1
    return bits, segments, radius


def sketch(values: np.ndarray, starts: np.ndarray, bits: int, seed: int = 1) -> np.ndarray:
    """One-bit minhashes, shape (sets, bits), of the 64-bit elements of sets that begin at ``starts``."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 2**63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, bits, dtype=np.uint64)
    out = np.empty((len(starts), bits), dtype=bool)
    step = max(1, min(bits, 4_000_000 // max(1, len(values))))
    with np.errstate(over="ignore"):
        for i in range(0, bits, step):
            h = values[None, :] * mult[i : i + step, None] + plus[i : i + step, None]
            h ^= h >> np.uint64(29)
            least = np.minimum.reduceat(h, starts, axis=1)
            least = (least ^ (least >> np.uint64(33))) * _C1
            least = (least ^ (least >> np.uint64(33))) * _C2
            out[:, i : i + step] = (least >> np.uint64(63)).astype(bool).T
    return out


def _sketcher(bits: int, segments: int):
    total = max(HEAD, bits * segments)

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 2000):
                f = whole.iloc[at : at + 2000]
                sizes = f["e"].map(len).to_numpy()
                values = np.concatenate(f["e"].to_list()).astype(np.int64).view(np.uint64)
                code = sketch(values, np.concatenate(([0], np.cumsum(sizes)[:-1])), total)
                head = np.packbits(code[:, :HEAD], axis=1).view(">u8").astype(np.uint64).view(np.int64)
                cut_up = code[:, : bits * segments].reshape(len(f), segments, bits)
                keys = cut_up.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(segments, dtype=np.int64) << 32)
                yield pd.DataFrame({"rep": f["rep"].to_numpy(), "n": sizes, "c0": head[:, 0], "c1": head[:, 1], "c2": head[:, 2], "keys": list(keys)})

    return run


def classes(df: DataFrame, record: str, values: str, min_size: int = 1) -> DataFrame:
    """(id, rep, s): every record with its class, the least id that has an equal set, and the sorted set.

    Null and blank values don't count, nor repeats of a value; null or empty
    arrays, and sets of fewer than ``min_size`` values, give no row; of rows
    with one id the one with the smallest set is taken; null ids are left out.
    """
    clean = F.array_sort(F.array_distinct(F.filter(col(values).cast("array<string>"), lambda x: x.isNotNull() & ~x.rlike(r"(?U)\A\s*\z"))))
    sets = df.filter(col(record).isNotNull()).select(col(record).alias("id"), clean.alias("s")).filter(F.size("s") >= max(1, min_size))
    sets = sets.groupBy("id").agg(F.min("s").alias("s")).withColumn("k", F.sha2(F.to_json("s"), 256))
    reps = sets.groupBy("k").agg(F.min("id").alias("rep"))
    return cut(lookup_salted(sets, reps.hint("merge"), "k", "inner").select("id", "rep", "s"))


def _close(radius: int, threshold: float) -> Column:
    distance = sum((F.bit_count(F.col(f"l.c{i}").bitwiseXOR(F.col(f"r.c{i}"))) for i in (1, 2)), F.bit_count(F.col("l.c0").bitwiseXOR(F.col("r.c0"))))
    return (F.least("l.n", "r.n") >= F.lit(threshold) * F.greatest("l.n", "r.n") - 1e-9) & (distance <= radius)


def similar_sets(member: DataFrame, threshold: float, other: DataFrame | None = None, recall: float = RECALL) -> DataFrame:
    """(rep_a, rep_b, jaccard) of class representatives (see :func:`classes`) of similarity >= ``threshold``.

    Within one table rep_a < rep_b. With ``other`` (classes of a second table)
    rep_a comes from ``member`` and rep_b from ``other``, and equal sets are
    pairs too. Empty in, empty out.
    """
    def sketched(m: DataFrame) -> DataFrame:
        reps = m.filter("id = rep").select("rep", F.transform("s", lambda x: F.xxhash64(x)).alias("e"))
        return cut(reps.repartition(m.sparkSession.sparkContext.defaultParallelism * 2).mapInPandas(_sketcher(bits, segments), "rep bigint, n int, c0 bigint, c1 bigint, c2 bigint, keys array<bigint>"))

    count = member.filter("id = rep").count() + (other.filter("id = rep").count() if other is not None else 0)
    bits, segments, radius = plan(count, threshold, recall)
    left = sketched(member)
    right = left if other is None else sketched(other)
    unfold = lambda d: d.select("rep", "n", "c0", "c1", "c2", F.explode("keys").alias("key"))
    near = _close(radius, threshold)
    if other is None:
        near = near & (F.col("l.rep") < F.col("r.rep"))
    # A segment that very many records share is split on both sides by adaptive execution, which leaves no task with all its pairs.
    found = unfold(left).alias("l").join(unfold(right).alias("r").hint("merge"), (F.col("l.key") == F.col("r.key")) & near).select(F.col("l.rep").alias("rep_a"), F.col("r.rep").alias("rep_b")).distinct()
    found = cut(found)
    sets = lambda d, a, s: d.filter("id = rep").select(F.col("rep").alias(a), F.col("s").alias(s)).hint("merge")
    with_sets = found.join(sets(member, "rep_a", "sa"), "rep_a").join(sets(member if other is None else other, "rep_b", "sb"), "rep_b")
    common = F.size(F.array_intersect("sa", "sb"))
    return with_sets.withColumn("jaccard", common / (F.size("sa") + F.size("sb") - common)).filter(F.col("jaccard") >= threshold).select("rep_a", "rep_b", "jaccard")


def links_per_record(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, links): every record with its class and the number of other records its set is similar to."""
    sizes = member.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(pairs.select(F.col("rep_b").alias("a"), F.col("rep_a").alias("b")))
    outside = both.join(sizes.hint("merge"), both.b == sizes.rep).groupBy("a").agg(F.sum("n").alias("out"))
    per = sizes.join(outside.hint("merge"), sizes.rep == outside.a, "left").select("rep", (F.col("n") - 1 + F.coalesce("out", F.lit(0))).alias("links"))
    return lookup_salted(member.select("id", "rep"), per.hint("merge"), "rep", "inner").select("id", "rep", "links")


def expand(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of records: the class pairs multiplied out, and the pairs within a class."""
    m = member.select("id", "rep")
    a, b = m.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), m.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = pairs.select("rep_a", "rep_b").join(a.hint("merge"), "rep_a").join(b.hint("merge"), "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    inside = m.alias("l").join(m.alias("r").hint("merge"), (F.col("l.rep") == F.col("r.rep")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b"))
    return across.unionByName(inside)
