import json

from driftline.operators import empirical as E
from driftline.sources import bronze, sinks


def test_pairs_and_issue_resolution(spark, tmp_path):
    side = {"project": "o_r", "type": "issue", "issue_number": 7, "title": "", "merged_at": "2020-01-01T00:00:00Z", "resolved_by": {"type": "pr", "number": "9", "merged_sha": "abc", "title": "t", "file_names": ["x"]}}
    bad = {"project": "o_r", "type": "pr"}
    (tmp_path / "p.json").write_text(json.dumps([{"pair_index": 1, "Source": side, "Infestor": side | {"file_names": []}}, {"pair_index": 2, "Source": side, "Infestor": bad}]))
    bronze.to_lines(spark, str(tmp_path / "p.json"), str(tmp_path / "lines"))
    again = bronze.sides_of(bronze.read_pairs(spark, str(tmp_path / "lines"), lines=True))
    rows = bronze.sides_of(bronze.read_pairs(spark, str(tmp_path / "p.json"))).collect()
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert {(r.pair_index, r.role, r.kind, r.number, r.title, tuple(r.file_names)) for r in rows} == {(1, "Source", "pr", "9", "t", ("x",)), (1, "Infestor", "pr", "9", "t", ("x",))}


def test_fetch_only_what_is_missing(spark):
    req = spark.createDataFrame([("u1",), ("u2",)], "url string")
    cache = bronze.missing(req, spark.createDataFrame([], "key string")).filter("url = 'u1'").select("key")
    todo = bronze.missing(req, cache)
    assert [r.url for r in todo.collect()] == ["u2"]
    row = bronze.fetch(todo, lambda u: 1 / 0).first()
    assert row.body is None and row.error.startswith("ZeroDivisionError")


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.append_new(df, str(tmp_path / "t"), ["k"]) == 2 and sinks.append_new(df, str(tmp_path / "t"), ["k"]) == 0
    assert "| 1 | a |" in sinks.markdown_table("T", df.orderBy("k")) and sinks.bar_chart("T", df, "v", "k").startswith("<svg")


def test_times(spark):
    from pyspark.sql import functions as F

    texts = ["2020-01-02T03:04:05Z", "2020-01-02T03:04:05+00:00", "2020-01-02 03:04:05", "2020-13-40", "unknown", "", None]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(E.parse_time(F.col("x")).alias("t")).collect()]
    assert len(set(got[:3])) == 1 and got[3:] == [None] * 4
