"""Token counts against the library's own, whole text by whole text."""

import random

import pytest

from popspark.llm import queries, tokencount

VOCABULARY = tokencount.vocabulary_file(tokencount.VOCABULARY)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


def odd_text(rng, n):
    parts = ["don't ", "''re", "<|endoftext|>", "<|startoftext|>x", "<|endof", "ẹ́", "̣ȧ", "İ", "ΑΣ ", "日本語", "한국", "한", "12", " 3", ".,!", "\n\n", " ", "\x1c", " ", "word", "Word ", "≠", "😀", "‍", "x" * 40, "\t", "</w>"]
    return "".join(rng.choice(parts) for _ in range(n))


def counted(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in tokencount.count_tokens(docs, **more).collect()), key=str)


def test_query_equals_the_library_on_every_text(spark, sf, whole):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.queries()["op11_count_tokens"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: (len((r.text or "").encode()), n := whole(r.text), n > 2048) for r in docs}
    assert got == want and len(got) == len(docs)


def test_chunks_are_spliced_exactly(spark, whole):
    rng = random.Random(5)
    rows = [(i, odd_text(rng, rng.choice((1, 30, 90, 400, 1500)))) for i in range(60)]
    want = sorted(((i, len(t.encode()), whole(t)) for i, t in rows), key=str)
    assert counted(spark, rows, chunk=64, overlap=64) == want
    assert counted(spark, rows, chunk=400, overlap=100) == want


def test_endless_words_widen_the_overlap_until_one_window_holds_them(spark, whole):
    rows = [(1, "ab" * 700), (2, "x" * 100 + " " + "y" * 900 + " tail words here" * 20), (3, "e" + "́" * 500 + "q" * 300), (4, "'" * 900), (5, "<|endoftext|>" * 90), (6, "七" * 1000)]
    assert counted(spark, rows, chunk=96, overlap=64) == sorted(((i, len(t.encode()), whole(t)) for i, t in rows), key=str)


def test_nulls_repeats_empty_tables_and_other_columns(spark, whole):
    rows = [(1, None), (1, "two words"), (1, "two words"), (None, "two words"), (None, None), (2, ""), (3, "word " * 500)]
    want = sorted(((i, len((t or "").encode()), whole(t)) for i, t in rows), key=str)
    assert counted(spark, rows, chunk=100, overlap=64) == want
    docs = spark.createDataFrame([("a", "one two", 1, 2, {"k": 1})], "doc_id string, text string, row int, tokens int, chunk map<string,int>")
    assert [tuple(r) for r in tokencount.count_tokens(docs).collect()] == [("a", 7, 2)]
    none = tokencount.digest(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == [] and none.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_an_overlap_larger_than_its_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        tokencount.count_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), chunk=64, overlap=65)


def test_a_vocabulary_with_unknown_steps_is_encoded_whole(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokencount.vocabulary_file("byte_bpe_50k.json"))
    text = "some  words \n\n here " * 40
    assert not tokencount.encoder("byte_bpe_50k.json").local
    assert counted(spark, [(1, text)], vocabulary="byte_bpe_50k.json", chunk=64, overlap=64) == [(1, len(text), len(t.encode(text, add_special_tokens=False)))]
