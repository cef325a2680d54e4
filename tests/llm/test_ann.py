import math

import numpy as np

from popspark.llm import ann

FLOATS = "array<float>"
SCHEMA = "vec_id long, embedding array<float>, label int, dim int"


def plain(rows, k=20, every=20):
    fine = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        fine.append((i, [float(np.float32(x)) for x in v] if FLOATS in SCHEMA else v))
    out = []
    for a, (q, x) in enumerate(fine):
        if q % every:
            continue
        best = sorted((-product(x, v), i) for b, (i, v) in enumerate(fine) if a != b and len(v) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def product(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b  # sum() would compensate for rounding
    return -math.inf if math.isnan(total) else total


def run(spark, rows, **options):
    got = ann.nearest(ann.valid_vectors(spark.createDataFrame(rows, SCHEMA)), **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_against_all_pairs(spark, sf):
    rows = [(r.vec_id, r.embedding, 0, 1) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same = rows[3][1]
    rows += [(1000 + i, same, 0, 0) for i in range(60)]
    rows += [(2000, None, 0, 0), (2020, [0.0] * 64, 0, 0), (2040, [math.nan] + [1.0] * 63, 0, 0), (2060, [None] + [1.0] * 63, 0, 0), (2080, [math.inf] * 64, 0, 0), (None, same, 0, 0), (2100, [1.0, 2.0], 0, 0), (2101, [3.0, -1.0], 0, 0), (2120, [1e-30] * 64, 0, 0), (1000, rows[5][1], 0, 0), (1000, rows[6][1], 0, 0), (40, rows[7][1], 0, 0)]
    assert run(spark, rows) == plain(rows)


def test_blocks_and_sub_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(900, 8)) * rng.lognormal(size=(900, 1)) * 10
    data[100:200] = data[7]
    rows = [(int(i), [float(x) for x in v], 0, 0) for i, v in enumerate(data)]
    monkeypatch.setattr(ann, "QUERY_BLOCK", (10, 10))
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", (200, 200))
    assert run(spark, rows, k=5) == plain(rows, 5)


def test_bound_holds():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 33)), rng.normal(size=(60, 33)) * 1e3
    (a, s, n, r), (b, t, m, u) = ann.quantise(x), ann.quantise(y)
    near = (a @ b.T) * s[:, None] * t[None, :]
    bound = n[:, None] * u[None, :] + r[:, None] * (m + u)[None, :]
    assert (np.abs(near - x @ y.T) <= bound * (1 + 1e-9)).all()


def test_tile_survivors_are_few(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    found = ann.tile(np.arange(0, 40), x[:40], np.arange(3000), x, 20)
    assert len(found) == 800


def test_large_magnitudes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(80, 6)) * 10.0 ** rng.integers(-200, 300, size=(80, 1))
    data[3] = [1e308, -1e308, 1e308, 1.0, 0.0, 0.0]
    rows = [(i, [float(x) for x in v], 0, 0) for i, v in enumerate(data)]
    monkeypatch.setattr("tests.llm.test_ann.SCHEMA", SCHEMA.replace(FLOATS, "array<double>"))
    assert run(spark, rows) == plain(rows)


def test_empty_and_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0], 0, 0), (21, [2.0], 0, 0)]) == [(20, 1, 21, 2.0)]
