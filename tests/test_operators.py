import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import diff as D
from driftline.operators import history as H
from driftline.operators import judge as J
from driftline.operators import metrics as M
from driftline.operators import ranking as R
from driftline.operators import retrieval as T
from driftline.operators import symbols as Y

PATCH = """--- a/x.go
+++ b/x.go
@@ -10,5 +10,6 @@ func a
 keep := this + line
-old := value + 1
+new := value + 2
+extra := call(x)
 tail := other + thing
@@ -40 +41 @@
-gone := value * 3
\\ No newline at end of file"""


def walk(patch):
    """The same by a plain loop."""
    old = new = 0
    for line in patch.splitlines():
        if line.startswith("@@"):
            a, b = line.split("-", 1)[1].split(" +")
            old, new = int(a.split(",")[0]), int(b.split(",")[0].split(" ")[0])
        elif line.startswith(("+++", "---")):
            continue
        elif line.startswith("+"):
            yield "added", new, line[1:].strip()
            new += 1
        elif line.startswith("-"):
            yield "deleted", old, line[1:].strip()
            old += 1
        else:
            yield "context", old, line.strip()
            old, new = old + 1, new + 1


@pytest.fixture(scope="module")
def patches(spark):
    return spark.createDataFrame([(1, PATCH), (2, None), (3, ""), (4, "@@ bad @@\n+a = b + c")], "id int, patch string")


def test_diff_lines_equal_a_sequential_walk(patches):
    got = [(r.kind, r.new if r.kind == "added" else r.old, r.text) for r in D.hunk_lines(patches.filter("id = 1"), ["id"]).orderBy("pos").collect()]
    assert got == list(walk(PATCH))
    assert D.hunk_lines(patches.filter("id in (2, 3)"), ["id"]).count() == 0
    assert D.hunk_lines(patches.filter("id = 4"), ["id"]).count() == 1


def test_changed_ranges(patches):
    assert [(r.start, r.end) for r in D.changed_ranges(patches.filter("id = 1"), ["id"]).orderBy("hunk").collect()] == [(11, 12), (40, 40)]


def test_ground_truth_pairs(patches):
    got = {(r.kind, r.old_start, r.new_start) for r in D.statement_ground_truth(patches.filter("id = 1"), ["id"]).collect()}
    assert got == {("edited", 11, 11), ("added_new", 11, 12), ("deleted", 40, None)}


def test_symbols_by_braces(spark):
    text = "package p\n\nfunc (r *T) Do(x int) {\n\tif x {\n\t}\n}\n\ntype T struct {\n\ta int\n}\nvar z = 3\n"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    rows = Y.parse_symbols(df, ["id"]).orderBy("start_line").collect()
    assert [(r.kind, r.name, r.start_line, r.end_line) for r in rows] == [("method", "Do", 3, 6), ("type", "T", 8, 10), ("var", "z", 11, 11)]


def test_round_robin_equals_a_loop(spark):
    random.seed(4)
    rows = [(q, random.choice("abc"), i) for q in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "q int, g string, pos int")
    got = {}
    for r in R.round_robin(df, ["q"], ["g"], [F.col("pos")], 15, cap=6).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.pos)
    for q in (1, 2):
        groups = {}
        for _, g, i in [r for r in rows if r[0] == q]:
            groups.setdefault(g, []).append(i)
        want = []
        for turn in range(6):
            want += [g[turn] for g in groups.values() if turn < len(g)]
        assert got[q] == want[:15]


def test_merge_ranks_with_head(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "q int, path string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "w", 2)], "q int, path string, rank int")
    out = lambda **k: [r.path for r in R.merge_ranks([a, b], ["q"], ["path"], "rank", 9, **k).orderBy("rank").collect()]
    assert out() == ["x", "y", "z", "w"] and out(head=1) == ["x", "z", "w", "y"]


def test_source_quota(spark):
    s = "pair_index int, source_path string, path string, score double, source_order int"
    exact = spark.createDataFrame([(1, "a", "a", 1.0, 1)], s)
    pool = spark.createDataFrame([(1, "a", "m", 0.2, 1), (1, "b", "n", 0.1, 2), (1, "b", "o", 0.05, 2), (1, "a", "p", 0.15, 1)], s)
    assert [r.path for r in R.source_quota(exact, pool, "pair_index", 3).orderBy("rank").collect()] == ["a", "m", "n"]


def test_judgements_cover_every_side_and_prefer_the_largest_path(spark):
    df = spark.createDataFrame([(1, "s1", "t1", 0.5), (1, "s2", "t1", 0.5), (1, "s1", "t2", 0.1)], "pair_index int, source_path string, path string, score double")
    got = {(r.source_path, r.path) for r in T.judgements(df).collect()}
    assert got == {("s2", "t1"), ("s1", "t2")}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "q int, path string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "c"), (3, "z")], "q int, path string")
    rows = {(r.q, r.k): r for r in M.file_metrics(ranked, truth, ["q"], "path", [1, 2]).collect()}
    assert rows[1, 2].precision == 0.5 and rows[1, 2].recall == 0.5 and rows[1, 2].rr == 0.5 and rows[3, 1].f1 == 0.0 and (2, 1) not in rows
    micro = {r.k: r for r in M.micro(ranked, truth, ["q"], "path", [2]).collect()}[2]
    assert micro.precision == pytest.approx(0.5) and micro.recall == pytest.approx(1 / 3) and micro.hit_rate == pytest.approx(1 / 3)


def test_weighted_merge_ignores_nulls(spark):
    df = spark.createDataFrame([("m", 1.0, 1), ("m", None, 5), ("m", 0.0, 3)], "method string, v double, n int")
    assert M.weighted_merge(df, ["method"], ["v"], "n").first().v == 0.25


def test_as_of(spark):
    p = spark.createDataFrame([(1, 5, "p"), (1, 1, "q"), (2, 9, "r")], "k int, t int, name string")
    h = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 6, 60)], "k int, t int, v int")
    assert {r.name: r.out for r in H.as_of(p, h, "k", "t", "t", "v", "out").collect()} == {"p": 50, "q": None, "r": None}


def test_judge_keeps_what_it_does_not_name(spark):
    c = spark.createDataFrame([(1, f"f{i}", i) for i in range(1, 5)], "pair_index int, path string, rank int")
    tasks = spark.createDataFrame([(1, "fix f3")], "pair_index int, task string")
    req = J.prompts(tasks, c, ["pair_index"], "task", "path", "rank")
    order = lambda judge: [r.path for r in J.reorder(c, J.ask(req, judge), ["pair_index"], "path", "rank", 4).orderBy("rank").collect()]
    assert order(lambda p: '{"order": ["2", "9", "x", "2"]}') == ["f3", "f1", "f2", "f4"]
    assert order(lambda p: None) == ["f1", "f2", "f3", "f4"] and order(lambda p: 1 / 0) == ["f1", "f2", "f3", "f4"]
    assert order(J.overlap_judge)[0] == "f3"
    with pytest.raises(ValueError):
        J.assert_no_truth(c.withColumn("target_files", F.lit(1)))


def test_uct(spark):
    df = spark.createDataFrame([(2.0, 0), (2.0, 4)], "v double, n int").select(J.uct(F.col("v"), F.col("n"), F.lit(9)).alias("u"))
    assert [round(r.u, 4) for r in df.collect()] == [float("inf"), 1.4105]


def test_structure_graph(spark):
    nodes, edges = Y.structure_graph(spark.createDataFrame([("o/r", "a/b.go"), ("o/r", "a/c.go")], "repo string, path string"), "repo", "path")
    assert nodes.count() == 4 and {r.source for r in edges.collect()} == {"repo::o/r", "dir::o/r::a"}
    last = Y.upsert_nodes(spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "id string, seq int, v string"), "seq").first()
    assert last.v == "new"
