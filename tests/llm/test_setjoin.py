import random

import pytest
from pyspark.sql import functions as F

from driftline.llm.setjoin import classes, expand, links_per_record, plan, similar_sets
from driftline.runtime import cut


def brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.fixture(scope="module")
def data(spark):
    random.seed(6)
    sets, names = {}, [f"n{i}" for i in range(300)]
    for i in range(120):
        base = random.sample(names, random.randrange(3, 12)) + ["hot"]
        sets[2 * i] = set(base)
        near = set(base)
        for _ in range(random.randrange(0, 3)):
            near.discard(random.choice(sorted(near)))
            near.add(random.choice(names))
        sets[2 * i + 1] = near
    for i in range(1000, 1080):  # a group of copies
        sets[i] = {"x", "y", "z"}
    rows = [(k, [*sorted(v), None, " ", next(iter(v))]) for k, v in sets.items()] + [(5000, None), (5001, []), (5002, [None]), (None, ["a", "b", "c"]), (0, [*sorted(sets[0])])]
    return sets, spark.createDataFrame([(a, b, 1) for a, b in rows], "id bigint, names array<string>, rep int")


def test_equals_brute_force(data):
    sets, df = data
    member = classes(df, "id", "names", 3)
    whole = {k: v for k, v in sets.items() if len(v) >= 3}
    pairs = similar_sets(member, 0.6)
    got = {(r.id_a, r.id_b) for r in expand(member, pairs).collect()}
    assert got == brute(whole, 0.6)
    links = {r.id: r.links for r in links_per_record(member, pairs).collect()}
    want = dict.fromkeys(whole, 0)
    for p in brute(whole, 0.6):
        for i in p:
            want[i] += 1
    assert links == want


def test_between_two_tables(spark, data):
    _, df = data
    a, b = classes(df.filter("id < 40"), "id", "names"), classes(df.filter("id >= 40 and id < 80").unionByName(df.filter("id = 4").withColumn("id", F.lit(44).cast("bigint"))), "id", "names")
    got = {(r.rep_a, r.rep_b) for r in similar_sets(a, 0.9, b).collect()}
    assert all(x < 40 <= y for x, y in got)


def test_nothing_is_broadcast_by_an_estimate(spark, data, tmp_path, monkeypatch):
    from driftline.llm import setjoin

    data[1].write.parquet(f"{tmp_path}/t")  # a file has a size, which estimates start from
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(setjoin, "cut", seen)
    member = classes(spark.read.parquet(f"{tmp_path}/t"), "id", "names", 3)
    pairs = similar_sets(member, 0.6)
    for df in (expand(member, pairs), links_per_record(member, pairs)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    # The tables are tiny: every join without a hint is a broadcast one.
    assert sum("SortMergeJoin" in p for p in plans) == 4 and not any("Broadcast" in p for p in plans)


def test_empty(spark):
    member = classes(spark.createDataFrame([], "id bigint, names array<string>"), "id", "names")
    assert similar_sets(member, 0.6).count() == 0


def test_plan_reaches_its_recall():
    for n in (10, 10**4, 10**7):
        bits, segments, radius = plan(n, 0.6, 0.999)
        assert 1 - (1 - 0.8**bits) ** segments >= 0.999 and 38 < radius < 75
