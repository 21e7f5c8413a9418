from pyspark.sql import functions as F

from driftline import runtime as R


def test_lookup_with_a_hot_key_equals_a_join(spark):
    big = spark.range(30_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 100).cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("1", 2), ("3", 3), ("none", 4)], "k string, v int")
    for how in ("left", "inner"):
        got = R.lookup_salted(big, small, "k", how).select("id", "v")
        want = big.join(small, "k", how).select("id", "v")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        counts = big.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("__n"))
        assert R.lookup_salted(big, small, "k", how, counts).select("id", "v").exceptAll(want).count() == 0
        cold = big.filter("k <> 'hot'")
        assert R.lookup_salted(cold, small, "k", how).count() == cold.join(small, "k", how).count()
    nulls = big.withColumn("k", F.when(F.col("id") < 100, F.col("k")))
    assert R.lookup_salted(nulls, small, "k").count() == 30_000
    assert R.lookup_salted(big.limit(0), small, "k").count() == 0


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    import types

    import pytest

    session = lambda master, named: types.SimpleNamespace(conf={"spark.checkpoint.dir": named}, sparkContext=types.SimpleNamespace(master=master))
    assert R.shared_folder(session("spark://host:7077", "hdfs:///x")) == "hdfs:///x" and R.shared_folder(session("local[4]", None))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            R.shared_folder(session(master, None))


def test_helpers(spark, tmp_path):
    assert R.fresh(["a", "A_1"], "A") == "A_2"
    assert R.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([("./a",), (" b ",), (" \n",), (None,)], "x string")
    assert [r.y for r in df.select(R.tidy_path(F.col("x")).alias("y")).collect()] == ["a", "b", "", None]
    assert [r.y for r in df.select(R.blank(F.col("x")).alias("y")).collect()] == [False, False, True, True]
    assert R.cut(df).count() == 4
