"""Evidence of later changes, held against plain loops."""

import re
from difflib import SequenceMatcher

import pytest

from driftline.functions.text import TOKEN_ALL
from driftline.operators import evidence as V

TEXTS = ["return x + 1", "return x + 2", "if err != nil { return err }", "total = count * rate", "total := counts * rates", "pool.Add(tx, 3)", "pool.Drop(tx, 3)", "for i := 0; i < n; i++ {", "foo"]


def similarity(a, b):
    x, y = set(re.findall(TOKEN_ALL, a.lower())), set(re.findall(TOKEN_ALL, b.lower()))
    return 0.55 * SequenceMatcher(None, a.strip(), b.strip()).ratio() + 0.45 * len(x & y) / len(x | y)


def test_deletions_count_in_whichever_file(spark):
    lines = ["return x + 2", "if err == nil { return err }", "total = counts * rate", "pool.Add(tx, 4)", "unlike anything (else)", "foo"]
    p = spark.createDataFrame([(k, f"new/{i}.go", i, t) for k in (1, 2) for i, t in enumerate(lines)], "pair_index int, path string, line int, line_text string")
    d = spark.createDataFrame([(1, f"old/{i}.go", i, t) for i, t in enumerate(TEXTS)] + [(1, "old/z.go", 99, TEXTS[1])], "pair_index int, path string, line_no int, text string")
    got = {(r.pair_index, r.line): r for r in V.statement_evidence(p, d).collect()}
    want = {}
    for i, t in enumerate(lines):
        best = max((o for o in TEXTS if len(o) >= 4), key=lambda o: similarity(t, o))
        if similarity(t, best) >= 0.68:
            want[1, i] = (best, f"old/{TEXTS.index(best)}.go", similarity(t, best))
    assert len(want) >= 4 and got.keys() == want.keys()
    for k, (text, path, s) in want.items():
        assert (got[k].deleted_text, got[k].deleted_path) == (text, path) and got[k].similarity == pytest.approx(s, abs=1e-6)
