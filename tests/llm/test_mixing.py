import hashlib
import math
import re

import pytest

from popspark.llm import mixing


def plain_targets(sizes, share=1.5):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        left = budget - sum(target.values())
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            free.discard(s)


def documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    return rows + [(5001, None, None), (5002, "a b c", None), (5003, "", "src1"), (5003, "", "src1"), (None, "d e", "src2"), (5004, "only", "zz"), (5005, None, "zero"), (5006, "tie tie", "é")]


def test_targets_and_takes(spark, sf):
    rows = documents(spark, sf)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(mixing.prepare(df, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
        largest[source] = max(largest.get(source, 0), size(text))
    want = plain_targets(sizes)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), size(t)) for d, t, _ in rows)
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert all(abs(r.target - want[source]) < 1e-6 * max(1, want[source]) and r.source_size == sizes[source] for r in mine)
        assert abs(sum(r["size"] * r.copies for r in mine) - want[source]) <= largest[source] / 2 + 1e-6
        whole = math.floor(want[source] / sizes[source] + 1e-12) if sizes[source] else 0
        assert all(whole <= r.copies <= min(2, whole + 1) for r in mine)


def test_sample_is_sorted_by_key(spark, sf):
    rows = documents(spark, sf)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prepared = mixing.prepare(df, None)
    hashes = {(r.doc_id, r.text_hash): r for r in prepared.collect()}
    got = mixing.plan(prepared).collect()

    def key(r):
        digest = hashlib.md5(f"mix-1|{'' if r.doc_id is None else r.doc_id}|{r.text_hash}".encode()).hexdigest()
        return -math.log((int(digest[:12], 16) + 0.5) / 16.0**12)

    assert len(hashes) == len(rows) - 1
    for source in {r.source for r in got}:
        mine = sorted((r for r in got if r.source == source), key=key)
        whole = min(r.copies for r in mine)
        rest, before = mine[0].target - whole * mine[0].source_size, 0
        if len({r.copies for r in mine}) == 1:
            continue
        for r in mine:
            assert r.copies - whole == (1 if before + r["size"] / 2 <= rest else 0)
            before += r["size"]


def test_weights_favour_good_documents(spark):
    rows = [(i, "a b c d", "s") for i in range(4000)]
    labels = [(i, i % 2, 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(mixing.prepare(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), share=0.3).collect()
    good = sum(r.copies for r in got if r.doc_id % 2)
    assert sum(r.copies for r in got) == 1200 and good / 1200 > 0.7


def test_mix_repeats_rows_and_empty(spark, sf):
    df = spark.createDataFrame([(1, "a b c d", "s", 1), (2, "e f", "s", 2), (3, None, "t", 3)], "doc_id long, text string, source string, mix_n int")
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == 10 or sum(len((r.text or "").split()) for r in out.collect()) == 8
    assert {r.mix_n for r in out.collect()} <= {1, 2, 3} and mixing.mix(df.limit(0)).count() == 0


def test_mix_gives_equal_rows_all_their_copies(spark):
    rows = [(1, "a b c d", "s", k % 2) for k in range(5)] + [(1, "a b c d", "t", 0)] * 3 + [(i, f"w{i} x y z", "s", 0) for i in range(10, 40)] + [(None, None, "t", 0)] * 4 + [(50, "u v", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    for share in (0.7, 1.0, 1.5, 1.9):
        want = {}
        for r in mixing.plan(mixing.prepare(df, None), share=share).collect():
            want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
        got, by_row = {}, {}
        for r in mixing.mix(df, share=share).collect():
            got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
            by_row[r] = by_row.get(r, 0) + 1
        assert got == {k: v for k, v in want.items() if v}
        assert by_row == {} or max(v for r, v in by_row.items() if r.source == "s") <= 6


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000, None: 5}, {"a": 1}, {"a": 0, "b": 0}, {"x": 3, "y": 1_000_000, "z": 7, "w": 9}])
def test_water_level(spark, sizes):
    got = mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long"))
    want = plain_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got.collect())
