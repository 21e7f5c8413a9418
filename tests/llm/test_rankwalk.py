import random

import numpy as np
import pytest

from driftline.llm import rankwalk
from driftline.llm.rankwalk import DAMPING, rank_walk, ranks, walk


def dense(group, scores):
    """The same chain as a matrix."""
    first = np.array([0])
    rs = ranks(group, first, scores)
    n = len(group)
    m = np.zeros((n, n))
    for r in rs:
        up = (r[None, :] > r[:, None] + 1e-12) / n
        up[np.arange(n), np.arange(n)] = 1 - up.sum(1)
        m += up / len(rs)
    p = np.full(n, 1 / n)
    for _ in range(300):
        p = DAMPING * p @ m + (1 - DAMPING) / n
    return p


def test_walk_equals_the_matrix_chain():
    rng = np.random.default_rng(3)
    scores = [rng.integers(0, 6, 40).astype(float), rng.exponential(50, 40), rng.random(40)]
    scores[2][:15] = np.nan
    assert walk(np.zeros(40, int), scores) == pytest.approx(dense(np.zeros(40, int), scores), abs=1e-9)


def test_groups_do_not_touch_and_scale_does_not_matter():
    rng = np.random.default_rng(4)
    a, b = rng.random(30), rng.random(30)
    alone = walk(np.zeros(30, int), [a, b])
    both = walk(np.r_[np.zeros(30, int), np.ones(30, int)], [np.r_[a, a], np.r_[b * 1e6, np.exp(b)]])
    assert both == pytest.approx(np.r_[alone, alone])
    assert walk(np.zeros(0, int), []).size == 0


def frame(spark):
    random.seed(3)
    rows = [(g, i, random.random() if random.random() > 0.2 else None, random.expovariate(1) * 100, float("nan") if random.random() < 0.3 else float(random.randrange(10)), "x") for g in (1, None) for i in range(60 if g else 20)]
    return spark.createDataFrame(rows + [(3, 1, None, None, None, "y")], "g int, i int, a double, b double, c double, __size string")


def test_nulls_ties_small_groups_and_empty(spark):
    df = frame(spark)
    out = rank_walk(df, "g", ["i"], ["a", "b", "c"], min_items=20)
    rows = out.collect()
    assert len(rows) == 80 and out.columns == ["g", "i", "a", "b", "c", "walk_weight"]
    assert sum(r.walk_weight for r in rows if r.g == 1) == pytest.approx(60)
    assert rank_walk(df.limit(0), "g", ["i"], ["a"]).count() == 0
    assert [r.walk_weight for r in rank_walk(df.filter("g = 3"), "g", ["i"], ["a", "b"]).collect()] == [1.0]


def test_large_groups_have_the_exact_walk(spark):
    df = frame(spark)
    a = {(r.g, r.i): r.walk_weight for r in rank_walk(df, "g", ["i"], ["a", "b", "c"]).collect()}
    # groups 1 and null are large, group 3 is not; with more bins than rows nothing is interpolated
    b = {(r.g, r.i): r.walk_weight for r in rank_walk(df, "g", ["i"], ["a", "b", "c"], group_limit=10).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-7


def test_interpolated_curves_keep_the_ranking(spark, monkeypatch):
    monkeypatch.setattr(rankwalk, "BINS", 64)
    rng = np.random.default_rng(5)
    n = 4000
    quality = rng.random(n)
    rows = [(1, i, float(quality[i] + rng.normal() * 0.2), float(np.exp(5 * quality[i]) * rng.random()), float(round(quality[i] * 4)), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double, c double, gid string")
    a = {r.i: r.walk_weight for r in rank_walk(df, "g", ["i"], ["a", "b", "c"]).collect()}
    b = {r.i: r.walk_weight for r in rank_walk(df, "g", ["i"], ["a", "b", "c"], group_limit=100).collect()}
    top = lambda m: sorted(m, key=lambda k: (-m[k], k))[:50]
    # 63 items a bin: four times what a group of a million has at 4,096 bins
    assert len(set(top(a)) & set(top(b))) >= 49 and top(a)[:5] == top(b)[:5] and max(abs(a[k] - b[k]) for k in a) < 0.01
