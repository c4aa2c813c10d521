import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
ENCODER = bpe.Encoder.load(bpe.default_path())
LIBRARY = tokenizers.Tokenizer.from_file(bpe.default_path())


def check(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode(text) == ids
    assert ENCODER.decode(ids).decode() == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text("aabbtheé \n\t'sld1\x1c\x85\xa0<|>endoftext", max_size=80))
def test_likely_text(text):
    check(text)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 5000, "ab" * 2000, " " * 700, "\n\n x\n", "it's we'll I'D"])
def test_fixed_texts(text):
    check(text)


def test_long_texts_in_blocks(monkeypatch):
    text = "Some words, and more; 12345 and é. " * 500
    want = ENCODER.encode(text)
    monkeypatch.setattr(bpe, "BLOCK", 100)
    assert ENCODER.encode(text) == want


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder.load(bpe.default_path())
    encoder.encode(" ".join(f"w{i}" for i in range(1000)))
    assert len(encoder.memory) <= 10


def test_round_trip_of_tables(spark, odd_docs, make_docs):
    tokens = bpe.encode_documents(odd_docs)
    back = sorted((r.doc_id or 0, r.text) for r in bpe.decode_documents(tokens).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    assert bpe.encode_checked(odd_docs).where("not round_trip").count() == 0
    assert bpe.encode_documents(make_docs([])).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id BIGINT, token_ids ARRAY<INT>")
    assert bpe.decode_documents(nothing).first().text == ""


def test_query_digests_match_the_library(spark, odd_docs, tmp_path):
    """op5 over a small table against the tokenizers library, row by row."""
    texts = [None, "", "a<|endoftext|> b", "It's 2024, naïve café\u0301s; 日本語 🎉\n\n  tabs\t", "ab" * 3000, " " * 900 + "x", "\ufffd \x00\x01", "The quick brown fox. " * 2000]
    rows = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING"))
    rows.withColumn("n_tokens", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in rows.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((str(r.doc_id), len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5_bpe(spark, str(tmp_path)).collect()) == sorted(want)
