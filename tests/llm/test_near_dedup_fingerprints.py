"""The pipeline's near-dedup goes by SimHash fingerprints on bit planes; sets confirm and complete it."""

import random

import corpus_pipeline
import numpy as np
import pytest
from popspark.llm import similar, simhash

from .test_simhash import plain_components
from .test_similar import plain_kept, plain_set


def clusters(rng, many, size, flips):
    """Fingerprints about so many centres, each with up to so many bits flipped."""
    out = set()
    for _ in range(many):
        centre = rng.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(size)}
    return np.array(sorted(out), np.uint64)


def groups(fps, links):
    mine = {i: i for i in range(len(fps))}
    at = {int(f): i for i, f in enumerate(fps)}

    def find(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for a, b in links:
        mine[find(at[a])] = find(at[b])
    low = {}
    for i in range(len(fps)):
        low.setdefault(find(i), i)
    return [low[find(i)] for i in range(len(fps))]


def test_bit_planes_count_past_three():
    fps = clusters(random.Random(1), 3, 50, 9)
    for radius in range(3, 9):
        rows = np.unpackbits(simhash.BitPlanes(fps).within(np.arange(len(fps)), radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
        assert (rows.astype(bool) == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_close_pairs_join_what_all_pairs_join(spark):
    # Files of one member, of a few and of more than SMALL (flips in the low bytes alone leave six bytes equal).
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    large = {centre ^ rng.getrandbits(16) for _ in range(3 * simhash.SMALL)}
    fps = np.array(sorted({*clusters(rng, 12, 12, 5).tolist(), *large, *(rng.getrandbits(64) for _ in range(200))}), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for radius in (1, simhash.WIDE):
        links = [tuple(int(x) % (1 << 64) for x in r) for r in simhash.close_pairs(frame, radius).collect()]
        assert all(0 < (a ^ b).bit_count() <= radius for a, b in links)
        want = plain_components(list(range(len(fps))), [int(x) for x in fps], radius)
        assert groups(fps, links) == [want[i] for i in range(len(fps))]
    assert simhash.close_pairs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.close_pairs(frame, 8)


def test_set_fingerprints():
    for text in [None, "", "One", "a b c d e", " ".join(f"w{i}" for i in range(300))]:
        x = similar.shingles(text)
        fp = similar.fingerprint(x)
        assert -(1 << 63) <= fp < 1 << 63 and fp == similar.fingerprint(similar.shingles(f" {text.upper()}\t" if text else None))
    assert similar.fingerprint(similar.shingles(None)) == 0


def test_near_dedup_goes_by_fingerprints(spark, sf, monkeypatch):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 40, 2):
        text = words(600)
        rows += [(i, " ".join(text)), (i + 1, " ".join([*text[:300], "edit", *text[301:]]))]
    # Similar texts whose fingerprints are mostly too far apart, and texts without words.
    for i in range(100, 160, 2):
        text = words(30)
        rows += [(i, " ".join(text)), (i + 1, " ".join([*text, *words(4)]))]
    rows += [(200, None), (201, " "), (202, "one"), (203, "one")]
    asked = []
    compare = simhash.close_pairs

    def seen(distinct, *more):
        out = compare(distinct, *more)
        asked.append((distinct.count(), {frozenset((r.a, r.b)) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "close_pairs", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    assert kept == plain_kept(rows)
    fp = {d: similar.fingerprint(similar.shingles(t)) for d, t in rows}
    (given, pairs), = asked
    assert given == len({fp[d] for d, t in rows if plain_set(t)})
    far = lambda i: (fp[i] ^ fp[i + 1]) % (1 << 64)
    near = [i for i in (*range(0, 40, 2), *range(100, 160, 2)) if 0 < far(i).bit_count() <= simhash.WIDE]
    assert len([i for i in near if i < 40]) > 15 and all(frozenset((fp[i], fp[i + 1])) in pairs for i in near)
    # Others are found by the sets alone.
    assert any(far(i).bit_count() > simhash.WIDE and i + 1 not in kept for i in range(100, 160, 2))


def test_fingerprints_are_confirmed_and_completed(spark, monkeypatch):
    """Whatever pairs fingerprints give, all or none, the groups are those of the sets."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 60, 3):
        text = words(rng.randrange(6, 80))
        rows += [(i, " ".join(text)), (i + 1, " ".join([*text, "tail"])), (i + 2, " ".join([*text[: len(text) // 2], *words(20)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = lambda fps, *_: fps.selectExpr("fp as a").join(fps.selectExpr("fp as b")).where("a < b")
    for given in (every, lambda fps, *_: every(fps).limit(0)):
        monkeypatch.setattr(simhash, "close_pairs", given)
        assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == plain_kept(rows)
