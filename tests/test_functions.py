from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import paths as P
from driftline.functions import seqratio as S
from driftline.functions import text as X
from driftline.functions import vectors as V


def one(spark, expr, **row):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<int>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expr.alias("x")).first().x


def test_first_truthy_skips_empty(spark):
    assert one(spark, X.first_truthy(F.col("a"), F.col("b")), a="", b="z") == "z"
    assert one(spark, X.first_truthy(F.col("a"), F.col("b")), a="", b=None) is None


@pytest.mark.parametrize("a,b,zero,one_", [([], [], 0.0, 1.0), (["x"], [], 0.0, 0.0), (["x", "y"], ["y", "z"], 1 / 3, 1 / 3)])
def test_two_jaccards(spark, a, b, zero, one_):
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(zero)
    assert one(spark, X.jaccard(F.col("a"), F.col("b"), 1.0), a=a, b=b) == pytest.approx(one_)


def test_dice_jaccard(spark):
    assert one(spark, X.dice_jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(0.6 * 0.5 + 0.4 / 3)
    assert one(spark, X.dice_jaccard(F.col("a"), F.col("b")), a=[], b=["y"]) == 0


def test_normalize_code_drops_everything_behind_a_comment(spark):
    assert one(spark, X.normalize_code(F.col("a")), a='x := 3 + f("s") // note\ny = 2') == "ID := ID + ID ( ID )"


def test_predicates(spark):
    for text, want in [("}", False), ("// x y z", False), ("return nil, err", True), ("a b", False), ("a = b", True), ("", False), (None, False)]:
        assert one(spark, X.meaningful(F.col("a")), a=text) is want, text


def test_change_type_is_a_substring_search(spark):
    assert one(spark, X.change_type(F.col("a")), a="update the prefix") == "bug_fix"
    assert one(spark, X.change_type(F.col("a")), a="tidy wording") == "maintenance"
    assert one(spark, X.change_type(F.col("a")), a=None) == "maintenance"


def test_proximity_and_gate(spark):
    for line, want in [(10, 1.0), (12, 0.75), (15, 0.45), (20, 0.25), (21, 0.0)]:
        assert one(spark, X.proximity_score(F.col("l"), F.col("s")), l=line, s=[10]) == want
    assert one(spark, X.proximity_score(F.col("l"), F.array().cast("array<int>")), l=3) == 0.0
    gate = X.evidence_gate(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert one(spark, gate, a=0.1, b=0.45, c=1, d=0.0) and not one(spark, gate, a=0.1, b=0.44, c=2, d=1.0)


def test_replies(spark):
    assert one(spark, X.valid_ids(F.col("a"), 3), a=["2", "x", "0", "2", "3", "-1"]) == [2, 0]
    assert one(spark, X.clamp01(F.col("a"), 0.4), a="7") == 1.0 and one(spark, X.clamp01(F.col("a"), 0.4), a="no") == 0.4
    assert one(spark, X.json_object(F.col("a"), "k int")["k"], a="sure:\n```json\n{\"k\": 4}\n```") == 4


def test_paths(spark):
    assert one(spark, P.stem(F.col("a")), a="x/Foo_test.go") == "foo"
    assert one(spark, P.extension(F.col("a")), a="x.d/Makefile") == ""
    assert one(spark, P.tidy(F.col("a")), a=" ./a/b.go\t") == "a/b.go"
    assert one(spark, P.node_id(F.lit("dir"), F.col("a")), a="p::q") == "dir::p__q"


def test_ratio_is_difflib(spark):
    long = "abc " * 70
    for a, b in [("abcd", "bcde"), ("", ""), ("x", long), (long, "x"), ("naïve", "naive")]:
        assert one(spark, S.ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(SequenceMatcher(None, a, b).ratio())
    assert one(spark, S.ratio(F.col("a"), F.col("b")), a=None, b="x") is None
    assert one(spark, S.path_score(F.col("a"), F.col("b")), a="a/b.go", b="a/b.go") == 1.0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 5.0]), (2, None)], "k int, v array<double>")
    rows = {r.k: r.vector for r in V.mean_vectors(df, "k", "v").collect()}
    want = np.array([0.3, 0.9]) / np.linalg.norm([0.3, 0.9])
    assert rows[1] == pytest.approx(list(want)) and 2 not in rows
    out = V.encode_contexts(np.eye(2), np.eye(2), np.eye(2), np.array([1, 0]), np.ones((3, 6)), np.ones(3))
    assert np.linalg.norm(out) == pytest.approx(1.0)
    assert not V.encode_contexts(np.eye(2), np.eye(2), np.eye(2), np.zeros(2), np.ones((3, 6)), np.ones(3)).any()
