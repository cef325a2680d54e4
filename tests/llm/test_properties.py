"""Properties over generated inputs, without Spark."""

import gzip
import io
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from popspark.llm import ann, langid, licenses, secrets, simhash, warc

from .test_simhash import plain_fingerprint


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBc \t\n\x0b.é😀\x00", max_size=60))
def test_fingerprint_equals_its_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**12 - 1), min_size=2, max_size=80), st.integers(0, 3))
def test_links_connect_what_all_pairs_connect(values, radius):
    fps = np.array(sorted(values), np.uint64)
    group = {int(f): int(f) for f in fps}
    for child, root in simhash.group_links(fps, radius):
        group[child] = root
    plain = {int(f): {int(f)} for f in fps}
    for a in fps.tolist():
        for b in fps.tolist():
            if (a ^ b).bit_count() <= radius and plain[a] is not plain[b]:
                merged = plain[a] | plain[b]
                for x in merged:
                    plain[x] = merged
    assert all((group[a] == group[b]) == (b in plain[a]) for a in group for b in group)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_every_match_satisfies_its_trigram_query(data):
    for rule in secrets.BASE_RULES + secrets.MORE_RULES:
        text = data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True)).lower()
        for group in secrets.trigram_query(rule.pattern):
            assert any(all(t in text for t in alternative) for alternative in group), (rule.kind, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.one_of(st.none(), st.text(max_size=20)), st.one_of(st.none(), st.binary(max_size=200))), max_size=6))
def test_records_round_trip(records):
    raw = b""
    for page, url, payload in records:
        digest = warc.base32_sha1(payload or b"")
        raw += gzip.compress(warc.make_record(page, url, payload, digest, len(payload or b""), 7 if payload is None else None), mtime=0)
    back = [warc._row(h, b) for h, b in warc.read_records(io.BytesIO(raw))]
    assert [(r[0], r[2], r[4], r[6]) for r in back] == [(p, len(b or b""), "revisit" if b is None else "response", b) for p, _, b in records]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 10**6))
def test_tile_finds_the_nearest(n, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, size=(n, 5)).astype(float) * rng.choice([1e-3, 1.0, 1e3], size=(n, 1))
    x[np.abs(x).sum(axis=1) == 0] = 1.0
    ids = rng.permutation(n)
    found = sorted(ann.tile(ids[:3], x[:3], ids, x, k))
    want = []
    for q in range(min(3, n)):
        scores = ann.exact_products(np.repeat(x[q : q + 1], n, axis=0), x)
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[q])[:k]
        want += [(int(ids[q]), i, -s) for s, i in best]
    assert [f[:2] for f in found] == [w[:2] for w in sorted(want)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=30), min_size=1, max_size=8))
def test_words_score_apart_as_together(words):
    pieces = ["a", "b", "c", "ab", "bc", "abc"]
    model = langid.Model(["x", "y"], pieces, np.random.default_rng(1).dirichlet(np.ones(6), 2).T)
    whole = model.words(words)
    assert all(np.allclose(whole[i], model.words([w])[0]) for i, w in enumerate(words)) and np.isfinite(whole).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, len(licenses.TEMPLATES) - 1), st.text(alphabet="xyz \n", max_size=80), st.text(alphabet="xyz \n", max_size=80))
def test_a_planted_notice_is_found(i, before, after):
    name, notice = licenses.TEMPLATES[i]
    found = licenses.Scanner().scan(f"{before}\n{notice}\n{after}")
    assert name in {f[2] for f in found} or any(n == f[2] and notice in t for f in found for n, t in licenses.TEMPLATES)
