import random

import pytest
from pyspark.sql import functions as F

from driftline.llm.topn import highest_per_item, top_n_per_group


def brute(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "")
    return {(g, i + 1): r[1:] for g, rs in groups.items() for i, r in enumerate(sorted(rs, key=key)[:n])}


def test_equals_brute_force_with_a_hot_group_ties_and_nulls(spark):
    random.seed(2)
    rows = [(random.choice([7, 7, 7, 1, 2, None]), random.choice([None, 0.5, 0.25, random.random()]), random.choice([None, *"abcdefghij"]) ) for _ in range(900)]
    rows = sorted(set(rows), key=str)
    df = spark.createDataFrame(rows, "g int, s double, name string")
    got = {(r.g, r.position): (r.s, r.name) for r in top_n_per_group(df, ["g"], [("s", "desc"), ("name", "asc")], 5).collect()}
    assert got == brute(rows, 5)


def test_strings_compare_by_code_point_and_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, 1.0, "b", 9), (1, 1.0, "B", 8), (1, 1.0, "é", 7)], "g int, s double, name string, position int")
    out = top_n_per_group(df, ["g"], [("s", "desc"), ("name", "asc")], 2)
    assert out.columns == ["g", "s", "name", "position", "position_1"]
    assert [(r.name, r.position, r.position_1) for r in out.orderBy("position_1").collect()] == [("B", 8, 1), ("b", 9, 2)]


def test_equal_rows_each_have_a_position_and_groups_may_be_floats(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)] * 3 + [(0.5, 2.0)], "g double, s double")
    got = sorted((str(r.g), r.position) for r in top_n_per_group(df, ["g"], [("s", "desc")], 2).collect())
    assert got == [("0.5", 1), ("nan", 1), ("nan", 2)]


def test_empty_and_bad_n(spark):
    df = spark.createDataFrame([], "g int, s double")
    assert top_n_per_group(df, ["g"], [("s", "desc")], 3).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], [("s", "desc")], 0)


def test_highest_per_item_leaves_out_what_has_no_value(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.7), (1, "a", float("nan")), (1, "b", None), (None, None, 0.1)], "g int, i string, v double")
    assert {(r.g, r.i, r.v) for r in highest_per_item(df, ["g", "i"], "v").collect()} == {(1, "a", 0.7), (None, None, 0.1)}
    assert highest_per_item(df.filter(F.lit(False)), ["g"], "v").count() == 0
