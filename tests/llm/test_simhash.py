import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from popspark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root long"


def plain_fingerprint(text):
    fold = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(fold)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    parent = {i: i for i in range(len(fps))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(fps)):
        members = [ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None]
        out[i] = min(members) if members else None
    return out


def test_fingerprint_edge_cases():
    for text in [None, "", " \t\n", "One", "one TWO", "a b c d é ÉÀ x", "x " * 5000, "a\x0bb\x0cc\rd", "a\x00b c d e f"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bit_planes_match_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 6), replace=False))) for _ in range(300)], np.uint64))
    planes = simhash.BitPlanes(fps)
    for radius in range(4):
        rows = np.unpackbits(planes.within(np.arange(len(fps)), radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
        want = [[int(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps]
        assert (rows.astype(bool) == np.array(want)).all()
        linked = simhash.group_links(fps, radius)
        ids = plain_components(list(range(len(fps))), [int(x) for x in fps], radius)
        at = {int(f): i for i, f in enumerate(fps)}
        mine = {i: i for i in range(len(fps))}
        for child, root in linked:
            mine[at[child]] = at[root]
        groups = lambda m: sorted(sorted(i for i in m if m[i] == r) for r in set(m.values()))
        assert groups(mine) == groups(ids)


def test_near_duplicates_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    more = [(10_000 + i, t) for i, t in enumerate([None, "", "one", "one two", rows[0][1], rows[0][1] + " tail", rows[1][1]])] + [(None, rows[2][1]), rows[3], rows[3]]
    data = rows + more
    got = sorted(simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect(), key=str)
    fps = [plain_fingerprint(t) for _, t in data]
    comp = plain_components([d for d, _ in data], fps, 2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == sorted([type(got[0])(d, signed(fps[i]), comp[i]) for i, (d, _) in enumerate(data)], key=str)
    assert len({c for c in comp.values()}) < len(data)


def test_keep_first_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(400))
    data = [(5, long, "x", 1), (3, long, "y", 2), (3, long, "z", 2), (7, "other words stand here alone", "r", 3), (None, "no id", "n", 4)]
    df = spark.createDataFrame(data, SCHEMA)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 7]
    assert kept.where("doc_id is null").count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in simhash.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100
    with pytest.raises(ValueError):
        simhash.fingerprint_links(df.select(F.col("a").alias("fp")), 4)
