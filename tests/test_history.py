"""The whole score of a later change."""

import datetime

import pytest

SIDES = "side_id long, pair_index int, role string, title string, body string, message string, file_names array<string>"
PATCH = "pair_index int, side string, path string, line_no int, kind string, text string, ord int"


def test_patch_lines_messages_predictions_and_evidence_count(spark, tmp_path):
    from driftline.plans import retrieval_queries as Q

    now = datetime.datetime(2024, 1, 1)
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put([
        (1, 1, "Source", "Fix pool", "avoid overflow", "pool limits", ["a/x.go"]), (2, 1, "Infestor", "Other words", None, "avoid pool overflow\nlimits", ["b/y.go", "b/z.go"]),
        (3, 2, "Source", "Fix", None, None, ["a/x.go"]), (4, 2, "Infestor", "Fix", None, None, ["a/x.go"]),
    ], SIDES, "sides")
    put([(1, "Source", "a/x.go", 1, "deleted", "limit := cost + 1", 0), (1, "Infestor", "b/y.go", 5, "deleted", "limit := cost + 1", 0), (2, "Source", "a/x.go", 1, "added", "return nil , err", 0), (2, "Infestor", "a/x.go", 1, "deleted", "x := 3", 0)], PATCH, "patch_statements")
    put([(1, "agent", "b/z.go", 0.9, now), (1, "agent", "c/q.go", 0.8, now)], "pair_index int, method string, path string, confidence double, scored_at timestamp", "target_files")
    put([(1, "agent", "c/q.go", 3, 0.9, None, "limit := cost + 1"), (1, "agent", "c/q.go", 8, 0.8, None, "unlike ( anything )")], "pair_index int, method string, path string, line int, score double, target_symbol string, line_text string", "target_statements")
    # Files 1 of 2, equal patch lines, words avoid, pool, overflow of fix, pool, avoid, overflow, limits, one of two statements; pair 2 has nothing predicted and no line of the same kind.
    got = {r.pair_index: r.score for r in Q.later_change_scores(spark, str(tmp_path)).collect()}
    assert got == {1: pytest.approx(0.38 * 0.5 + 0.37 + 0.15 * 3 / 5 + 0.10 * 0.5, abs=1e-6)}
