"""Clones are looked for among all documents."""


def test_all_kinds_are_asked_for_and_searched(spark, tmp_path):
    from driftline.plans import retrieval_queries as Q

    rows = [(50, "alpha beta gamma delta", "issue"), (51, "alpha beta gamma delta", "mail"), (52, "alpha beta", "review"), (53, "other words", "commit"), (100, "other things", "release_note"), (150, "", "issue")]
    rows += [(i, "alpha beta gamma delta", "design") for i in range(40, 47)]
    spark.createDataFrame(rows, "doc_id long, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.other_id, r["rank"]) for r in Q.clone_retrieval_all(spark, str(tmp_path)).orderBy("doc_id", "rank").collect()]
    assert got == [(50, 40 + i, i + 1) for i in range(5)] + [(100, 53, 1)]
