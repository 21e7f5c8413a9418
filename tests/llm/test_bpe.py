import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from driftline.llm import bpe  # noqa: E402

TEXTS = [
    None, "", " ", "\n\n \t x", "don't <|endoftext|> we'll", "a" * 700 + " " * 200, "日本語のテキスト、123abc_def/ghi", "naïve café — “x”", "x\u3000y\u00a0z\u2028w", "🧪👩🏽‍💻 ok", "0xdeadbeef 12345678901234567890", "e\u0301\u200d\ufeff", "CamelCaseIdentifierLikeThis snake_case_name",
]


@pytest.fixture(scope="module")
def hf():
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_library(spark, hf):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*TEXTS, TEXTS[4]])], "doc_id int, text string, ids string")
    out = bpe.encode_corpus(df, "text")
    assert out.columns == ["doc_id", "text", "ids", "ids_1"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r.ids_1 == hf.encode(r.text or "", add_special_tokens=False).ids, repr(r.text)
    assert bpe.encode_corpus(df.limit(0), "text").count() == 0


def test_decoding_is_exact(spark):
    t = bpe.tokenizer()
    out = bpe.encode_corpus(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string"), "text")
    back = {r.doc_id: bytes(r.bytes) for r in t.decode(out, "doc_id", "ids").collect()}
    assert back == {i: (x or "").encode() for i, x in enumerate(TEXTS)}


def test_heap_equals_fold(spark):
    v = bpe.vocabulary(bpe.default_path())
    words = ["hello", " unbelievable", "zzzzqqqq", "éèê", "aaaaaaaaaaaaaaaa"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.tokenizer().fold(F.col("w")).alias("ids")).collect()
    assert all(r.ids == v.encode_bytes(r.w.encode()) for r in rows)
