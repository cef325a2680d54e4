"""Subsamples and shuffles by threshold and bins, against a plain sort by md5."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from popspark.operators import resampling, stages


def draw(seed, i, unit):
    return hashlib.md5("|".join([seed, str(i), *([] if unit is None else [str(unit)])]).encode()).hexdigest()


def plainly(rows, size, iterations, seed):
    """{(group, iter): the rows drawn}; rows are (group, unit, value)."""
    out = {}
    for g in {r[0] for r in rows}:
        for i in range(iterations):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (draw(seed, i, r[1]), r[1]))
            out[g, i] = mine[:size]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(g, u, rng.choice("xyz")) for g, n in (("a", 400), ("b", 30), (None, 120), ("small", 3)) for u in rng.sample(range(1000), n)]


@pytest.mark.parametrize(("size", "spread"), [(20, 6.0), (1000, 6.0), (350, 0.02)])
def test_counts_equal_a_sort_whatever_the_bracket(spark, rows, monkeypatch, size, spread):
    monkeypatch.setattr(resampling, "SPREAD", spread)
    df = spark.createDataFrame(rows, "g string, u int, v string").repartition(3)
    got = {(r.g, r.iter, r.v): r.n for r in resampling.subsample_counts(df, "u", size, 7, "s", ("v",), ("g",)).collect()}
    want = Counter()
    for (g, i), drawn in plainly(rows, size, 7, "s").items():
        for r in drawn:
            want[g, i, r[2]] += 1
    assert got == dict(want)


@pytest.mark.parametrize("spread", [6.0, 0.01])
def test_rows_equal_a_sort(spark, rows, monkeypatch, spread):
    monkeypatch.setattr(resampling, "SPREAD", spread)
    df = spark.createDataFrame(rows, "g string, u int, v string")
    got = sorted(((r.g, r.iter, r.u) for r in resampling.subsamples(df, "u", 25, 4, "q", ("g",)).collect()), key=str)
    assert got == sorted(((g, i, r[1]) for (g, i), d in plainly(rows, 25, 4, "q").items() for r in d), key=str)


def test_blocks_arrays_and_repeated_units(spark, monkeypatch):
    for name, value in (("BLOCK_UNITS", 3), ("BLOCK_ROWS", 10), ("MOST_ARRAYS", 2)):
        monkeypatch.setattr(resampling, name, value)
    rows = [(k % 3, u, (u + k) % 4) for u in range(60) for k in range(6)]
    df = spark.createDataFrame([(g, u, v) for g, u, v in rows if g < 1 or u < 40], "g int, u int, v int")
    got = resampling.subsample_counts(df.dropDuplicates(["g", "u"]), "u", 12, 5, "s", ("v",), ("g",))
    whole = got.groupBy("g", "iter").agg(F.sum("n").alias("n")).collect()
    assert len(whole) == 15 and {r.n for r in whole} == {12}
    assert resampling.subsample_counts(df.limit(0), "u", 12, 5, "s", ("v",)).collect() == []


def test_nothing_sorts_the_population_and_draws_run_once(spark, rows):
    df = spark.createDataFrame(rows * 1, "g string, u int, v string")
    plan = resampling.subsample_counts(df, "u", 20, 3, "s", ("v",), ("g",))._jdf.queryExecution().executedPlan().toString()
    # What is left reads the written draws: the population is neither multiplied nor ranked any more.
    assert "Generate explode(sequence" not in plan and "MapInArrow" not in plan and "LocalTableScan" not in plan


@pytest.mark.parametrize("bin_rows", [4096, 4])
def test_shuffled_labels_equal_a_sort(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(resampling, "BIN_ROWS", bin_rows)
    units = random.Random(2).sample(range(500), 90)
    labels = {u: f"l{u % 7}" for u in units}
    df = spark.createDataFrame(list(labels.items()), "u int, g string").repartition(5)
    got = {(r.iter, r.u): r.g for r in resampling.relabelled(df, "u", "g", 4, "z").collect()}
    order = sorted(units)
    want = {}
    for i in range(4):
        by = sorted(units, key=lambda u: (draw("z", i, u), u))
        want |= {(i, u): labels[by[k]] for k, u in enumerate(order)}
    assert got == want


def test_numbering_over_ranges_with_a_hot_value(spark):
    rows = [(7 if i % 3 else i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, x int").repartition(6)
    for range_rows in (500_000, 20):
        got = stages.numbered(df, ["k"], "place", 1, range_rows).collect()
        assert sorted(r.place for r in got) == list(range(1, 401)) and sorted((r.k, r.x) for r in got) == sorted(rows)
        ks = [r.k for r in sorted(got, key=lambda r: r.place)]
        assert ks == sorted(ks)
    down = stages.numbered(df, [F.desc("k"), "x"], "place", range_rows=20).orderBy("place").collect()
    assert [(r.k, r.x) for r in down] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert stages.numbered(df.limit(0), ["k"]).collect() == []


def test_leading_bits_are_those_of_md5():
    units = ["7", "10", "12345", None, "é", "x" * 45, "y" * 60, "", "99"]
    got = resampling._leading([None if u is None else u.encode() for u in units], "rare", 1203)
    for k, u in enumerate(units):
        for i in (0, 5, 9, 10, 99, 100, 999, 1000, 1202):
            fits = u is not None and len(f"rare|{i}|{u}".encode()) <= 55
            assert got[k, i] == (int(draw("rare", i, u)[:8], 16) if fits else 0)


def test_few_draws_are_worked_out_one_by_one(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(resampling, "md5", lambda m, f=resampling.md5: (calls.append(1), f(m))[1])
    rows = pa.table({"_unit": [str(i) for i in range(2000)], "v": ["x"] * 2000, "_low": [1 << 50] * 2000, "_high": [1 << 52] * 2000}).to_batches()

    class Rows:
        schema = {"v": type("f", (), {"dataType": type("t", (), {"simpleString": lambda self: "string"})()})()}

        def mapInArrow(self, run, schema):
            return list(run(iter(rows)))

    out = resampling._count_draws(Rows(), "s", 40, [], ["v"])
    under = [int(draw("s", i, u)[:15], 16) for u in range(2000) for i in range(40)]
    assert sum(b.num_rows for b in out if b.column("counts").null_count) == sum(1 << 50 <= x < 1 << 52 for x in under)
    assert len(calls) < 2000 * 40 / 50
