import os

import numpy as np
import pytest

from driftline.operators import context as K

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_runs_end_to_end(spark, tmp_path):
    from driftline.operators.judge import overlap_judge
    from driftline.plans import jobs

    files = jobs.file_localization(spark, DATA, 5).cache()
    assert files.count() and files.groupBy("pair_index").count().agg({"count": "max"}).first()[0] <= 5
    judged = jobs.file_localization(spark, DATA, 5, overlap_judge)
    assert {(r.pair_index, r.path) for r in judged.collect()} == {(r.pair_index, r.path) for r in files.collect()}
    lines = jobs.statement_localization(spark, DATA, files)
    f, s = jobs.evaluation(spark, DATA, files, lines)
    assert 0 < f.first().recall <= 1 and s.count() == 1
    assert jobs.ablation(spark, DATA, 5).count() == 4
    assert jobs.resume(files, str(tmp_path / "r")) == files.count() and jobs.resume(files, str(tmp_path / "r")) == 0
    assert "Latency in days" in jobs.empirical(spark, DATA, str(tmp_path))


def test_contexts_and_vectors(spark, tmp_path):
    paths = K.nesting_contexts("func a(x int) { return x + 3 }")
    assert ("x", "group", "int") in paths and all(len(p) == 3 for p in paths) and K.nesting_contexts("") == []
    df = spark.createDataFrame([(1, [2, 99, 0], [1, 1, 0], [2, 3, 0])], "k int, starts array<int>, paths array<int>, ends array<int>")
    v = K.function_vectors(df, ["k"], np.eye(4), np.eye(2), np.ones((3, 10)), np.ones(3)).first().vector
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-5)
    e = K.embed(spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string"), "t", lambda ts: np.array([[len(t), 0.0] for t in ts])).orderBy("k").collect()
    assert [list(r.vector) for r in e] == [[1.0, 0.0], [0.0, 0.0]]
    (tmp_path / "env").write_text("# c\nA=1\nB='2'\n")
    assert K.load_settings(str(tmp_path / "env"), {"A": "9"}) == {"A": "9", "B": "2"}
