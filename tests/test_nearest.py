"""Nearest sets: the same pairs as comparing every query with every document, without a row per pair."""

import random

import pyarrow as pa
import pytest


def brute(queries, documents, k):
    out = {}
    for q, a in queries:
        scored = []
        for d, b in documents:
            c = len(set(a) & set(b))
            if c:
                scored.append((-round(0.60 * (2.0 * c / (len(a) + len(b))) + 0.40 * (c / (len(a) + len(b) - c)), 6), d, c))
        out[q] = [(d, c) for _, d, c in sorted(scored)[:k]]
    return out


def sets(seed, ids):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, sorted({w for n, w in enumerate(words) if r.random() < 0.6 / (1 + n / 8)} | {f"r{r.randrange(80)}" for _ in range(r.randrange(6))}, key=lambda w: r.random())) for i in ids]
    return [(i, s if r.random() < 0.8 else rows[0][1]) for i, s in rows]  # many equal sets: ties go by id


@pytest.mark.parametrize(("widest", "frequent", "rows", "columns", "looked_up"), [(1024, 0.03, 512, 1024, 4_000_000), (3, 0.5, 7, 9, 5), (0, 0.5, 64, 16, 40)])
def test_blocks_give_the_exact_nearest(monkeypatch, widest, frequent, rows, columns, looked_up):
    from driftline.operators import nearest as N

    for name, v in {"WIDEST": widest, "FREQUENT": frequent, "ROWS": rows, "COLUMNS": columns, "LOOKED_UP": looked_up, "TOKENS": 900}.items():
        monkeypatch.setattr(N, name, v)
    queries, documents = sets(1, range(1000, 1070)), sets(2, random.Random(3).sample(range(500), 300))
    batch = lambda rows, k: list(N._packer(50, k)(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[x : x + 120]]), pa.array([r[1] for r in rows[x : x + 120]], pa.list_(pa.string()))], ["i", "s"]) for x in range(0, len(rows), 120)])))
    got = {q: [] for q, _ in queries}
    pairs = [(x, y) for x in batch(queries, None) for y in batch(documents, 4)]
    at = {id(x): i for i, (x, _) in enumerate(pairs)}
    cells = [(at[id(x)], *(x.column(c)[0] for c in range(4)), *(y.column(c)[0] for c in range(4))) for x, y in pairs]
    names = ["b", "qids", "qn", "qcodes", "qwords", "ids", "n", "codes", "words"]
    met = pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells]), *[pa.array([c[i].as_py() for c in cells], cells[0][i].type) for i in range(1, 9)]], names)
    found = list(N._meeting(4)(iter([met])))
    assert len({at[id(x)] for x, _ in pairs}) == len(found) > 1 and len(pairs) > 2 * len(found)
    sizes = dict(queries), dict(documents)
    for b in found:
        for q, d, nq, nd, c in zip(*b.to_pydict().values(), strict=True):
            assert (nq, nd) == (len(sizes[0][q]), len(sizes[1][d]))
            got[q].append((d, c))
    assert got == brute(queries, documents, 4)


def test_rounding_is_half_up_as_in_spark():
    import numpy as np

    from driftline.operators import nearest as N

    c, a, b = np.meshgrid(np.arange(1, 30), np.arange(30, 70, 3), np.arange(30, 400, 7))
    from decimal import ROUND_HALF_UP, Decimal

    s = 0.60 * (2.0 * c / (a + b)) + 0.40 * (c / (a + b - c))
    want = [int((Decimal(repr(float(x))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP)) for x in s.ravel()]
    assert N._clone_scores(c.ravel(), a.ravel(), b.ravel()).astype(int).tolist() == want


def test_clone_retrieval_forms_no_row_per_pair_of_common_tokens(spark, tmp_path):
    from driftline.operators import retrieval as T
    from driftline.plans import retrieval_queries as Q

    rows = [(i, f"the common words stand everywhere {'x' * (i % 7 + 2)} {'y' * (i % 11 + 2)}", "release_note" if i % 2 else "design") for i in range(400)]
    # A quotation of many characters is one literal, empty texts and those without tokens match nothing.
    rows += [(1001, 'common "' + "a b " * 20_000 + '" words', "release_note"), (1003, "", "release_note"), (1005, "? !", "release_note"), (1006, None, "design"), (1008, "common lit words", "design")]
    spark.createDataFrame(rows, "doc_id long, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = Q.clone_retrieval(spark, str(tmp_path))
    assert "Generate" not in got._jdf.queryExecution().toString()
    found = got.collect()
    assert [(r.other_id, r.score) for r in found if r.doc_id == 1001][0] == (1008, 1.0)
    assert {r.doc_id for r in found} == {*range(1, 400, 2), 1001}
    words = {r.doc_id: r.t for r in docs.select("doc_id", T.clone_tokens(docs.text).alias("t")).collect()}
    kinds = {i: kind for i, _, kind in rows}
    want = brute([(i, words[i]) for i in words if kinds[i] == "release_note"], [(i, words[i]) for i in words if kinds[i] == "design"], 5)
    assert sorted((r.doc_id, r["rank"], r.other_id) for r in found) == sorted((q, n + 1, d) for q, ds in want.items() for n, (d, _) in enumerate(ds))


def test_clone_retrieval_all_forms_no_row_per_pair_of_common_tokens(spark, tmp_path):
    from pyspark.sql import functions as F

    from driftline.functions.text import clone_tokens
    from driftline.plans import retrieval_queries as Q

    r = random.Random(5)
    rows = [(i, "the common words stand everywhere " + " ".join(f"word{r.randrange(40)}" for _ in range(r.randrange(1, 30))), r.choice(["issue", "mail"])) for i in range(1500)]
    spark.createDataFrame([*rows, (1600, "", "issue")], "doc_id long, text string, kind string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.clone_retrieval_all(spark, str(tmp_path))
    assert "Generate" not in got._jdf.queryExecution().toString()
    words = {x.doc_id: x.t for x in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", clone_tokens(F.col("text")).alias("t")).collect() if x.t}
    want = {q: [d for d, _ in brute([(q, words[q])], [(d, t) for d, t in words.items() if d != q], 5)[q]] for q in words if q % 50 == 0}
    assert sorted((x.doc_id, x["rank"], x.other_id) for x in got.collect()) == sorted((q, n + 1, d) for q, ds in want.items() for n, d in enumerate(ds))
