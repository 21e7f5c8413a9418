"""The search tree against a step-by-step search, mapping through symbols and blocks, block metrics, hunks of several lines."""

import math

from pyspark.sql import functions as F

from driftline.operators import diff as D
from driftline.operators import empirical as E
from driftline.operators import history
from driftline.operators import mapping as A
from driftline.operators import metrics as M
from driftline.operators import search as H
from driftline.sources import bronze as B


def step_by_step(n_files, scores, n_lines, rounds):
    """Plans from the state, one round after the other, and hangs nodes one by one."""
    nodes = {0: dict(parent=None, visits=0, value=0.0, children=[], action="Root")}
    looked, mapped, viewed = False, 0, 0
    for turn in range(rounds):
        leaf = 0
        while nodes[leaf]["children"]:
            here = nodes[leaf]
            leaf = max(here["children"], key=lambda c: nodes[c]["value"] / nodes[c]["visits"] + 1.2 * math.sqrt(math.log(here["visits"] + 1) / nodes[c]["visits"]))
        if turn == 0:
            todo = [("InspectSourcePatch", 55.0)]
        elif not looked:
            looked = n_files > 0
            todo = [("FindSimilarFiles", 35 + 45 * (max(scores) if n_files else 0))]
        elif mapped < n_files:
            todo = [("MapPatchToTarget", 45 + 50 * scores[i] if scores[i] is not None else 20.0) for i in range(mapped, min(mapped + 3, n_files))]
            mapped += len(todo)
        elif viewed < min(3, n_lines):
            todo = [("ViewCode", 80.0)] * min(2, min(3, n_lines) - viewed)
            viewed += len(todo)
        else:
            todo = [("Finish", 90.0 if n_lines else 30.0)]
        for action, value in todo:
            new = len(nodes)
            nodes[new] = dict(parent=leaf, visits=0, value=0.0, children=[], action=action)
            nodes[leaf]["children"].append(new)
            at = new
            while at is not None:
                nodes[at]["visits"] += 1
                nodes[at]["value"] += value
                at = nodes[at]["parent"]
        if todo[0][0] == "Finish":
            break
    return [(i, n["parent"], n["action"], n["visits"], round(n["value"], 6)) for i, n in nodes.items() if i]


def test_search_tree_equals_a_search_step_by_step(spark):
    cases = {1: (7, [0.9, 0.8, 0.75, 0.7, 0.6, 0.5, 0.1], 5), 2: (0, [], 0), 3: (1, [0.4], 0), 4: (4, [0.3, 0.3, 0.2, 0.2], 1), 5: (8, [0.5] * 8, 3)}
    pairs = spark.createDataFrame([(k, 3) for k in cases], "pair_index int, statements int")
    files = spark.createDataFrame([(k, f"f{i}", float(s), i + 1) for k, (n, ss, _) in cases.items() for i, s in enumerate(ss)], "pair_index int, path string, score double, rank int")
    lines = spark.createDataFrame([(k, f"f{i % n}", 10 + i, float(cases[k][1][i % n]), i + 1, "x") for k, (n, _, m) in cases.items() for i in range(m)], "pair_index int, path string, line int, score double, rank int, text string")
    for rounds in (3, 12):
        got = {}
        for r in H.search_tree(H.planned(pairs, files, lines, rounds)).collect():
            got.setdefault(r.pair_index, []).append((r.node, r.parent, r.action, r.visits, r.total))
        for k, (n, ss, m) in cases.items():
            # a file without a mapped line is worth 20
            held = [s if i < m else None for i, s in enumerate(ss)]
            want = step_by_step(n, ss, m, rounds)
            if None not in held:
                assert sorted(got[k]) == want, k
            assert [(x[0], x[2]) for x in sorted(got[k])] == [(x[0], x[2]) for x in want], k


SOURCE = [("a/x.go", 1, "context", "func Load(limit int) error {", 0), ("a/x.go", 2, "deleted", "if limit > maxLimit { return errTooMany }", 1), ("a/x.go", 3, "added", "if limit > maxLimit + extra { return errTooMany }", 2), ("b/y.go", 1, "added", "value := cache.Get(key)", 0)]


def test_lines_through_symbols(spark):
    st = spark.createDataFrame([(1, *x) for x in SOURCE], "pair_index int, path string, line_no int, kind string, text string, ord int")
    files = spark.createDataFrame([(1, "t/x.go", "a/x.go"), (1, "t/y.go", "c/y.go"), (1, "t/z.go", "q/none.go"), (1, "t/w.go", None)], "pair_index int, path string, matched_source_path string")
    mapped = A.mapped_sources(st, files)
    assert {(r.path, r.source_path) for r in mapped.collect()} == {("t/x.go", "a/x.go"), ("t/y.go", "b/y.go"), ("t/z.go", "a/x.go"), ("t/z.go", "b/y.go"), ("t/w.go", "a/x.go"), ("t/w.go", "b/y.go")}
    symbols = spark.createDataFrame([(1, "a/x.go", "Load", 1, 4, SOURCE[1][3]), (1, "a/x.go", "Other", 9, 12, "func Other() {}")] + [(1, "b/y.go", f"S{i}", 20 + i, 20 + i, "x") for i in range(6)], "pair_index int, path string, name string, start_line int, end_line int, text string")
    around = A.symbols_of_patch(mapped, symbols)
    got = {}
    for r in around.collect():
        got.setdefault(r.path, set()).add(r.name)
    assert got["t/x.go"] == {"Load"} and got["t/y.go"] == {"S0", "S1", "S2", "S3"} and got["t/z.go"] == {"Load", "S0", "S1", "S2", "S3"}
    targets = spark.createDataFrame([(1, "t/x.go", "Load", 5, 8, "func Load(limit int) { if limit > maxLimit { return errTooMany } }"), (1, "t/x.go", "Unlike", 20, 22, "func Unlike() {}"), (1, "t/q.go", "Alone", 1, 2, "y")], "pair_index int, path string, name string, start_line int, end_line int, text string")
    ranked = {(r.path, r.name): r for r in A.rank_symbols(targets, around, A.file_patterns(mapped)).collect()}
    assert ranked["t/x.go", "Load"].rank == 1 and ranked["t/x.go", "Load"].match_score > 0.34 and ranked["t/q.go", "Alone"].match_score == 0.35
    lines = spark.createDataFrame([(1, "t/x.go", 6, "if limit > maxLimit { return errTooMany }"), (1, "t/x.go", 7, "return nil, errors.New(name)"), (1, "t/x.go", 15, "if limit > maxLimit { return errTooMany }"), (1, "t/y.go", 3, "value := cache.Get(key)"), (1, "t/y.go", 4, "import fmt as f")], "pair_index int, path string, line int, text string")
    found = {(r.path, r.line): r for r in A.mapped_lines(lines, mapped, A.rank_symbols(targets, around, A.file_patterns(mapped)), 5).collect()}
    # line 15 lies in no symbol of its file; a file without symbols has all its lines, but for those that frame code
    assert set(found) == {("t/x.go", 6), ("t/x.go", 7), ("t/y.go", 3)} and found["t/x.go", 6].similarity == 1.0 and found["t/y.go", 3].symbol_score == 0.0
    top = found["t/x.go", 6]
    assert abs(top.score - (0.58 + 0.25 * ranked["t/x.go", "Load"].match_score + 0.17 * min(1.0, 2 / 3))) < 1e-5


def test_expanded_blocks(spark):
    blocks = spark.createDataFrame([(1, "p", "B", 3, 9, 0.8, 1)], "pair_index int, path string, block string, start int, end int, block_score double, rank int")
    m = spark.createDataFrame([(1, "p", "B", 3, "i1", "insert", ["a := b + c"]), (1, "p", "B", 3, "i2", "delete", ["x.y(z, w)"])], "pair_index int, path string, block string, start int, intent_key string, intent string, texts array<string>")
    lines = spark.createDataFrame([(1, "p", 4, "x.y(z, w)"), (1, "p", 7, "a := b + c"), (1, "p", 30, "a := b + c")], "pair_index int, path string, line int, text string")
    got = {(r.line, r.action): r.score for r in A.expanded_blocks(blocks, m, lines, 10, 4).collect()}
    assert got[4, "DeleteRegion"] == round(0.42 * 0.8 + 0.48 + 0.05, 6) and got[7, "FindAffectedStatement"] == round(0.42 * 0.8 + 0.48 + 0.05, 6)
    assert {k for k in got if k[1] == "InsertAnchor"} == {(3, "InsertAnchor"), (8, "InsertAnchor"), (9, "InsertAnchor")} and got[3, "InsertAnchor"] == 0.596


def test_block_metrics(spark):
    blocks = spark.createDataFrame([(1, "p", 1, 5, 1), (1, "p", 20, 25, 2), (2, "p", 1, 2, 1)], "q int, path string, start int, end int, rank int")
    truth = spark.createDataFrame([(1, "p", 27), (1, "p", 27), (1, "p", 90), (1, "z", 3), (2, "o", 1), (3, "p", 1)], "q int, path string, anchor int")
    got = {r.q: (r.precision, r.coverage, r.rr) for r in M.block_metrics(blocks, truth, ["q"], 10, 2).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


PATCH = """--- a/f
+++ b/f
@@ -10,4 +10,5 @@ func f
 ctx := one(a)
-old := two(b)
-gone := never(c, d)
+old := two(b, more)
+fresh := zeta[1]
+other = plain
 end()
@@ -40,2 +41,1 @@
--- removed comment reads like a header
-last := call(x)
\\ No newline at end of file
"""


def test_hunks_of_several_lines(spark):
    p = spark.createDataFrame([(1, PATCH.replace("\\\\", "\\")), (None, "@@ -1 +1 @@\n-a := b(c)\n+a := b(d)"), (None, "@@ -1 +1 @@\n-a := b(c)\n+a := b(d)")], "k int, patch string")
    got = {(r.k, r.kind, r.old_start, r.new_start) for r in D.statement_ground_truth(p, ["k"]).collect()}
    assert got == {(1, "edited", 11, 11), (1, "deleted", 12, None), (1, "added_new", 12, 12), (1, "added_new", 12, 13), (1, "deleted", 40, None), (None, "edited", 1, 1)}
    assert {(r.k, r.start, r.end) for r in D.changed_ranges(p, ["k"]).collect()} == {(1, 11, 13), (1, 40, 40), (None, 1, 2)}


def test_sources_and_small_parts(spark):
    tree = spark.createDataFrame([("r", "s", "a/b.go", "blob"), ("r", "s", "a", "tree"), ("r", "s", "a/b_test.go", "blob"), ("r", "s", "x.pb.go", "blob")], "repo string, sha string, path string, type string")
    assert B.tree_paths(tree).count() == 3 and [r.path for r in B.plain_go_paths(tree).collect()] == ["a/b.go"]
    files = spark.createDataFrame([(1, "f", "@@"), (1, "f", None)], "k int, filename string, patch string")
    wanted = spark.createDataFrame([(1, "f"), (1, "g")], "k int, path string")
    assert {(r.path, r.patch) for r in B.file_patch(wanted, files, ["k"]).collect()} == {("f", "@@"), ("g", "")}
    assert spark.range(1).select(B.api_url("https://h/api/", F.lit("repos/o r/x")).alias("u")).first().u == "https://h/api/repos/o%20r/x"
    counts = spark.createDataFrame([(1, 250), (2, 0)], "k int, files int")
    assert sorted((r.k, r.page) for r in B.pull_pages(counts, counts, ["k"]).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert abs(spark.range(1).select(E.log_place(F.lit(9.0), 99.0, 10, 100).alias("x")).first().x - 60.0) < 1e-9
    changes = spark.createDataFrame([("r", 1, 0.5, 2), ("r", 2, 0.5, 1), ("r", 3, 0.5, None), ("r", 4, 0.05, 0), ("r", 5, 0.9, 9)], "s string, c int, score double, d int")
    assert [r.c for r in history.best_changes(changes, ["s"], "d", ["c"], top=3).orderBy("rank").collect()] == [5, 2, 1]
    need = spark.createDataFrame([(1, 2, [0.9, 0.5], 3, 1), (2, 9, [0.9], 1, 1), (3, 1, [0.50004, 0.5, 0.49999], 1, 1), (4, 1, [0.1], 0, 1), (5, 1, [0.1], 1, 0)], "k int, source_files int, confidences array<double>, statements int, exact int")
    assert {r.k for r in H.needs_judge(need).filter("needed").collect()} == {2, 3, 4, 5}
