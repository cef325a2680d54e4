"""Token alignment against all pairs of byte ranges, texts encoded whole."""

import hashlib
import random

import numpy as np
import pytest

from popspark.llm import alignment, queries
from popspark.llm.tokencount import vocabulary_file

from .test_tokencount import odd_text


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_file(alignment.BYTE_VOCABULARY))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(alignment.PIECE_VOCABULARY))
    letters = alignment._byte_letters()

    def tokens(text):
        if not text:
            return [], []
        one = [(i, bytes(letters[c] for c in t)) for e in [a.encode(" " + text, add_special_tokens=False)] for i, t in zip(e.ids, e.tokens, strict=True)]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        want = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == want == b"".join(x for _, x in two) else ([], [])

    return tokens


def ranges(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts, tokens):
    """For each text the row of op12 after the id, by comparing every two tokens."""
    docs = []
    for t in texts:
        a, b = map(ranges, tokens(t))
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in both:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)))
            low = cut
        docs.append((len(a), len(b), links, groups))
    held = {}
    for *_, links, _ in docs:
        for p in set(links):
            held[p] = held.get(p, 0) + 1
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    return [(na, nb, len(g), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, ls, g in docs]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_links_and_borders_equal_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        cut = lambda: np.append(np.flatnonzero(rng.random(n - 1) < rng.random()) + 1, n) if n > 1 else np.array([1])
        a, b = cut(), cut()
        first, last, border = alignment.links_and_borders(a, b)
        sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
        for i in range(len(a)):
            assert list(range(first[i], last[i] + 1)) == [j for j in range(len(b)) if sa[i] < b[j] and sb[j] < a[i]]
        assert [bool(x) for x in border] == [e in set(a.tolist()) for e in b.tolist()]


def test_an_index_finds_nested_starts_and_misses():
    index = alignment.Index(np.array([0, 5, 9]), np.array([3, 8, 12]))
    first, last = index.stab(np.array([3, 0, 4, 12]), np.array([5, 10, 6, 20]))
    assert [list(range(f, e + 1)) for f, e in zip(first, last, strict=True)] == [[], [0, 1, 2], [1], []]


@pytest.mark.parametrize("most", [alignment.MOST_COMMON, 0, 40])
def test_documents_equal_brute_force_at_any_broadcast(spark, whole, monkeypatch, most):
    monkeypatch.setattr(alignment.common_from, "__defaults__", (most,))
    rng = random.Random(8)
    texts = [odd_text(rng, rng.choice((1, 5, 40))) for _ in range(50)] + ["the cat  sat on the mat", "the the the", " lead", "▁x", "a▁ b", None, "", "the cat  sat on the mat", "<|endoftext|> </s>", "tab\tand\nnewline "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(alignment.align(docs)) == sorted(((i, *w) for i, w in enumerate(brute(texts, whole))), key=str)


def test_query_equals_brute_force(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(120)
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    fixture = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(alignment.align(fixture)) == sorted(((i, *w) for (i, _), w in zip(texts, brute([t for _, t in texts], whole), strict=True)), key=str)
    got = queries.queries()["op12_align_tokens"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_nulls_repeats_empty_tables_and_other_columns(spark, whole):
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (None, None), (2, "")]
    want = brute([t for _, t in rows], whole)
    assert rows_of(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)
    odd = spark.createDataFrame([("k", "word", 1, {"a": 1})], "doc_id string, text string, row int, links map<string,int>")
    assert alignment.align(odd).first().doc_id == "k"
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_common_pairs_are_bounded(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [5] * 6 + [900])], "pair long, n long")
    for most in (0, 1, 6, 7, 30, 100):
        least = alignment.common_from(counts, most)
        assert counts.where(f"n >= {least}").count() <= most and (least == 1 or counts.where(f"n >= {least // 2}").count() > most)
    assert alignment.common_from(counts.limit(0)) == 2
