import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.llm.components import artifact, components, linked_records
from driftline.llm.sql import P3


def truth(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            continue
        root.setdefault(a, a), root.setdefault(b, b)
        root[find(a)] = find(b)
    groups = {}
    for v in root:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


random.seed(1)
SHAPES = {
    "mixed": [(i, i + 1) for i in range(30)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 201 + i) for i in range(40)] + [(300, 301), (301, 300), (400, 400), (None, 5), (500, None)]
    + [(600 + random.randrange(80), 600 + random.randrange(80)) for _ in range(70)] + [(800 + random.randrange(30), 800 + random.randrange(30)) for _ in range(120)],
    "empty": [],
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("limit", [10**6, 0])
def test_labels_are_the_connected_groups(spark, name, limit):
    edges = SHAPES[name]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b", limit).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.label, set()).add(r.v)
    assert {frozenset(g) for g in groups.values()} == truth(edges) and len(rows) == len({r.v for r in rows})


def test_artifact_spellings(spark):
    sha = "5cf031e738a0" + "0" * 28
    same = [
        "https://x.example/o/r/pull/7", "http://www.X.example/O/R/pull/7/files?w=1#d", " https://x.example/o/r/pull/7.diff/ \n", "https://api.x.example/repos/o/r/pulls/7", "https://x.example/o/r.git/pull/7 ?tab=1",
    ]
    rows = spark.createDataFrame([(u,) for u in [*same, "https://x.example/o/r/issues/7", f"https://x.example/o/r/commit/{sha}.patch", None, "  ", "Odd Text/"]], "u string").select(artifact(F.col("u")).alias("a")).collect()
    got = [r.a for r in rows]
    assert set(got[:5]) == {"x.example/o/r/pull/7"} and got[5:] == ["x.example/o/r/issue/7", f"x.example/o/r/commit/{sha}", None, None, "odd text"]


def test_linked_records(spark):
    full, other = "abcdef0123456789abcdef0123456789abcdef01", "abcdef0999999999999999999999999999999999"
    u = "https://x.example/o/r/"
    rows = [
        ("c3", u + "pull/1", u + f"commit/{full}", 1), ("c1", u + f"commit/{full[:12]}", None, 2), ("c2", u + "pull/2", "", 3), ("c4", None, " ", 4), ("c5", u + "commit/abcdef0", u + "issues/2", 5),
        ("c6", u + f"commit/{other}", u + "pull/9", 6), ("c3", u + "pull/1", u + f"commit/{full}", 1), (None, u + "pull/9", u + "pull/2", 7),
    ]
    df = spark.createDataFrame(rows, "case_id string, s string, t string, label int")
    got = {(r.case_id, r.group_id) for r in linked_records(df, "case_id", ("s", "t")).collect()}
    # the short abcdef0 abbreviates two commits and so names neither; the record without an id still links c2 and c6
    assert got == {("c3", "c1"), ("c1", "c1"), ("c2", "c2"), ("c6", "c2"), ("c4", "c4"), ("c5", "c5")}
    assert linked_records(df.limit(0), "case_id", ("s", "t")).count() == 0


def test_a_record_links_what_all_its_rows_name(spark):
    u = "https://x.example/o/r/pull/"
    rows = [("2", u + "2", u + "3"), ("2", u + "10", u + "11"), ("1", u + "2", None), ("3", None, u + "11"), ("4", u + "20", ""), ("4", "", u + "21"), ("5", u + "21", None), (None, u + "30", None), (None, None, u + "31"), ("6", u + "30", None), ("7", u + "31", None)]
    got = {(r.case_id, r.group_id) for r in linked_records(spark.createDataFrame(rows, "case_id string, s string, t string"), "case_id", ("s", "t")).collect()}
    # rows without an id link each by itself, so 6 and 7 stay apart
    assert got == {("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("5", "4"), ("6", "6"), ("7", "7")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_cases_on_several_rows_equal_the_sql(spark, tmp_path):
    """The case table with every third case also standing on another case's row."""
    duckdb = pytest.importorskip("duckdb")
    cases = spark.read.parquet("/root/testdata/sf0.001/practical_localization_results_14.parquet").dropDuplicates(["case_id"])
    far = cases.orderBy(F.xxhash64("case_id")).withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("case_id"))))
    moved = far.filter("n % 3 = 0").select("case_id", (F.col("n") + 1).alias("n")).join(far.drop("case_id"), "n").select(*cases.columns)
    cases.unionByName(moved).coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW practical_localization_results_14 AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    both = spark.read.parquet(str(tmp_path / "c"))
    for limit in (0, 10**6):
        got = {(r.group_case_id, r.case_id) for r in linked_records(both, "case_id", ("source_url", "target_url"), "group_case_id", limit).collect()}
        assert got == set(con.sql(P3).fetchall())
