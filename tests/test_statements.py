"""Source statements against target lines, held against a plain loop."""

import os
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from driftline.functions.text import TOKEN_ALL
from driftline.operators import statements as S

DATA = "/root/testdata/sf0.001"
STATEMENTS = "pair_index int, side string, path string, line_no int, kind string, text string, ord int"
FILES = "pair_index int, path string, score double, matched_source_path string"
LINES = "pair_index int, path string, line int, text string"


def similarity(a, b):
    x, y = set(re.findall(TOKEN_ALL, a.lower())), set(re.findall(TOKEN_ALL, b.lower()))
    return 0.55 * SequenceMatcher(None, a.strip(), b.strip()).ratio() + 0.45 * len(x & y) / len(x | y)


def test_files_without_a_path_or_name_in_common_take_the_nearest_statements(spark):
    s = spark.createDataFrame([
        (1, "Source", "core/vm/gas.go", 9, "added", "gas := cost + 1", 0), (1, "Source", "docs/gas.md", 3, "deleted", "limit is set here", 1),
        (1, "Source", "core/vm/gas.go", 4, "deleted", "gas := cost * 2", 2), (1, "Source", "core/vm/new.go", 1, "context", "return stack . pop", 3),
    ], STATEMENTS)
    f = spark.createDataFrame([(1, "core/vm/stack.go", 0.5, "core/vm/lost.go"), (1, "eth/gas.go", 0.5, "eth/other.go"), (1, "x/y.go", 0.5, "lib/new.go"), (1, "core/vm/gas.go", 0.5, None)], FILES)
    got = {}
    for r in S.comparable(s, f).orderBy("path", "place").collect():
        got.setdefault(r.path, []).append((r.source_path, r.source_line))
    gas = [("core/vm/gas.go", 4), ("core/vm/gas.go", 9)]
    assert got == {"core/vm/gas.go": gas, "eth/gas.go": gas, "x/y.go": [("core/vm/new.go", 1)], "core/vm/stack.go": [gas[0], ("core/vm/new.go", 1), gas[1], ("docs/gas.md", 3)]}
    assert [r.source_line for r in S.comparable(s, f.filter("path = 'core/vm/stack.go'"), 1).collect()] == [4]


def test_every_line_has_its_best_statement_with_or_without_a_common_token(spark):
    texts = ["alpha beta gamma", "return x + 1", "return x + 1", "if err != nil { return err }", "total = count * rate", "zz"]
    lines = ["alphas betas gammas", "return x + 2", "foo ( bar )", "if err == nil { return nil }", "counts rates totals", "q1 q2 q3"]
    s = spark.createDataFrame([(1, "Source", "a.go", i, "added", t, i) for i, t in enumerate(texts)], STATEMENTS)
    f = spark.createDataFrame([(1, "a.go", 0.5, "a.go")], FILES)
    out = S.rank_statements(spark.createDataFrame([(1, "a.go", i, t) for i, t in enumerate(lines)], LINES), S.comparable(s, f), f, 10).collect()
    assert len(out) == len(lines)
    for r in out:
        sims = [similarity(t, r.line_text) for t in texts]
        best = max(sims)
        assert r.source_line == sims.index(best) and r.similarity == pytest.approx(best, abs=1e-6) and r.score == pytest.approx(0.7 * best + 0.15, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_line_ranking_leaves_no_pair_with_statements_and_lines_out(spark):
    from driftline.functions.text import meaningful
    from driftline.plans import common as C
    from driftline.plans import retrieval_queries as Q

    agent = C.ranked_files(spark, DATA).filter("method = 'agent' and rank <= 5").select("pair_index", "path")
    lines = C.table(spark, DATA, "target_statements").filter("line is not null").filter(meaningful(F.col("line_text"))).join(agent, ["pair_index", "path"], "left_semi")
    want = lines.join(C.statements(spark, DATA).filter("side = 'Source' and text is not null"), "pair_index", "left_semi").select("pair_index").distinct()
    assert want.exceptAll(Q.line_ranking(spark, DATA).select("pair_index").distinct()).count() == 0 and want.count()
