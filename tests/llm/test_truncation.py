import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm.truncation import cut_probability, fit_censored, limits, source_rates

WORDS = "the peer table keeps old blocks until every worker has read them and then drops what nobody asked for".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6, 18))).capitalize() + "."


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(5)
    x = np.minimum(np.exp(rng.normal(6, 0.5, 20_000)), 500).round()
    values, counts = np.unique(x, return_counts=True)
    mu, sd = fit_censored(values, counts, 500)
    assert mu == pytest.approx(6, abs=0.05) and sd == pytest.approx(0.5, abs=0.05)


def test_cut_texts_are_found(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 12)))
        source = "limited" if i % 2 else "free"
        if source == "limited" and len(text) > 300:
            text = text[:300]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif source == "free" and i % 100 == 0:
            text = text[: max(30, len(text) * 2 // 3)]
            if not text.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, text, source, 1.0))
    rows += [(9000, None, "free", 0.0), (9001, "", "free", 0.0), (9002, " \n", None, 0.0), (9003, "Fine as it is.", None, 0.0), (9003, "Fine as it is.", None, 0.0), (9004, "Long but whole. " * 20_000, "free", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, probability double")
    judged = cut_probability(df, "doc_id", "text", "source").cache()
    got = {r.doc_id for r in judged.filter("probability >= 0.5").collect()}
    assert len(got & cut) >= 0.93 * len(cut) and len(got - cut) <= 0.05 * len(cut)
    assert judged.filter("doc_id in (9000, 9001, 9002)").count() == 0 and judged.filter("doc_id = 9003").count() == 2
    rates = {r.source: r for r in source_rates(judged).collect()}
    assert rates["limited"].rate > 0.4 > rates["free"].rate


def test_a_source_of_two_limits(spark):
    rng = random.Random(9)
    rows, cut = [], set()
    for i in range(2400):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 22)))
        limit = {0: 300, 1: 700}.get(i % 5)
        if limit and len(text) > limit:
            text = text[:limit]
            if not text.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, text, None if i % 50 == 0 else "s"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged = cut_probability(df, "doc_id", "text", "source").cache()
    got = {r.doc_id for r in judged.filter("probability >= 0.5").collect()}
    # rows without a source are held against both limits
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    of = {i: len(t) for i, t, _ in rows}
    at = {of[r.doc_id] for r in judged.filter("at_limit").collect()}
    assert {300, 700} <= at and all(min(abs(x - 300), abs(x - 700)) <= 3 for x in at)


def test_long_words_are_beginnings_of_longer_ones(spark):
    """An unspaced line of 200 signs, cut at 90: its end is half of a word that stands elsewhere."""
    rng = random.Random(2)
    line = "".join(rng.choice("表删除节点数据块同步更新网络") for _ in range(200))
    rows = [(i, f"Note {line}\nIt was the table.", "a") for i in range(4)] + [(9, f"Note {line[:90]}", "a")] + [(20 + i, " ".join(sentence(rng) for _ in range(3)), "a") for i in range(40)]
    got = {r.doc_id: r.ending for r in cut_probability(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source").collect()}
    assert got[9] == "prose half" and got[0] == "sentence"


def test_limits_and_empty(spark):
    df = spark.createDataFrame([("a", 100 + i, 100 + i) for i in range(40)] + [("a", 150, 150)] * 30 + [(None, 9, 9)], "source string, chars bigint, bytes bigint").withColumn("h", F.monotonically_increasing_id())
    assert {(r.source, r.unit, r.limit) for r in limits(df).collect()} == {("a", "chars", 150), ("a", "bytes", 150)}
    assert cut_probability(spark.createDataFrame([], "doc_id bigint, text string, source string"), "doc_id", "text", "source").count() == 0
