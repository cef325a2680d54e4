"""Neighbours, overlaps, numbered lines and triangular factors against plain forms; no key or task holds them all."""

import math
import random

import numpy as np
import pytest

from popspark.operators import layout, matrices, neighbours
from popspark.sources import importers


def brute(points, k):
    out = {}
    for i, v in points.items():
        near = sorted((math.dist(v, w), j) for j, w in points.items() if j != i)
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("k", [1, 4, 500])
def test_nearest_equal_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = random.Random(k)
    points = {i: [float(rng.randint(0, 6)), float(rng.randint(0, 6))] for i in range(90)} | {900 + i: [50.0, 50.0] for i in range(30)}
    df = spark.createDataFrame([*points.items(), (5000, None)], "k int, v array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(df, "k", "v", k).collect():
        got.setdefault(r.src, []).append((r.rank, r.weight, r.dst))
    want = brute(points, k)
    assert got.keys() == want.keys()
    assert all([(w, d) for _, w, d in sorted(got[i])] == want[i] for i in want)


def test_pivots_prune_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [1000.0 * (i % 12) + rng.random(), rng.random()]) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    assert neighbours.pairs_compared(df, "k", "v", 3) < 600 * 600 / 4
    assert neighbours.nearest(df.limit(0), "k", "v", 3).collect() == [] and neighbours.nearest(df.limit(1), "k", "v", 3).collect() == []


@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_overlaps_equal_all_pairs_without_nested_loops(spark, monkeypatch, axes):
    monkeypatch.setattr(layout, "CROWD", 7)
    rng = random.Random(5)
    rows = [(i, float(rng.choice((1, 3, 6))), *(rng.uniform(-40, 40) for _ in "xyz")) for i in range(80)] + [(100 + i, 2.0, 5.0, 5.0, 5.0 + i / 100) for i in range(25)]
    nodes = spark.createDataFrame(rows, "id int, radius double, x double, y double, z double")
    found = layout.touching(nodes, axes)
    at = {r[0]: (r[1], [v for c, v in zip("xyz", r[2:], strict=True) if c in axes]) for r in rows}
    want = {(i, j) for i, (r, p) in at.items() for j, (s, q) in at.items() if i != j and r + s > math.dist(p, q)}
    assert {(r.id, r.other) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert layout.every_pair(nodes, axes).count() == len(rows) * (len(rows) - 1)


@pytest.mark.parametrize("text", ["a\nbb\r\n\nccc é\n", "a\nbb\n\nccc", "\n\n\n", "one", "x\n" * 200 + "last"])
def test_lines_are_numbered_alike_at_any_split(spark, tmp_path, text):
    path = tmp_path / "t.txt"
    path.write_bytes(text.encode())
    want = [(i + 1, x.removesuffix("\r")) for i, x in enumerate(text.split("\n"))]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("5" if len(text) < 20 else "100", held):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, importers.numbered_lines(spark, str(path)).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_factors_keep_digits_that_a_gram_table_loses(spark, monkeypatch):
    rng = np.random.default_rng(4)
    u, v = np.linalg.qr(rng.normal(size=(300, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    d = np.array([1.0, 1e-2, 1e-4, 1e-6, 1e-9, 1e-11])
    x = u * d @ v.T
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "k int, v array<double>").repartition(7)
    got, w, _, n = matrices.singular_values(df, "v")
    assert n == 300 and np.allclose(got, d, rtol=1e-4, atol=1e-16) and np.allclose(w.T @ w, np.eye(6))
    assert not np.allclose(np.sqrt(np.abs(np.linalg.eigvalsh(x.T @ x)[::-1])), d, rtol=1e-4, atol=1e-16)
    wide = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(3, 5)))], "k int, v array<double>")
    assert len(matrices.singular_values(wide, "v")[0]) == 3


def test_points_without_clusters_meet_by_blocks_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours.vector_pairs, "BLOCKS", 2)
    rng = random.Random(8)
    points = {3 * i: [float(rng.randint(0, 3)) if i % 2 else rng.gauss(0, 1) for _ in range(6)] for i in range(150)}
    df = spark.createDataFrame([*points.items(), (5000, None)], "k int, v array<double>").repartition(3)

    def refused(*args):
        raise AssertionError("a copy of each point for every cell")

    monkeypatch.setattr(neighbours, "_dealt", refused)
    got = {}
    for r in neighbours.nearest(df, "k", "v", 3).collect():
        got.setdefault(r.src, []).append((r.rank, r.weight, r.dst))
    want = brute(points, 3)
    assert got.keys() == want.keys()
    assert all([d for _, _, d in sorted(got[i])] == [j for _, j in want[i]] and all(math.isclose(w, x) for (_, w, _), (x, _) in zip(sorted(got[i]), want[i], strict=True)) for i in want)
