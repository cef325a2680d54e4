"""Quantiles by refinement against the aggregate that keeps every value."""

import math
import random

import pytest
from pyspark.sql import functions as F

from popspark.operators import quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def values(rng):
    return {
        "normal": [rng.gauss(0, 1) for _ in range(900)],
        "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(700)],
        "ties": [rng.choice((1.5, 1.5, 2.0, -7.0)) for _ in range(500)],
        "close": [1.0 + rng.randrange(2000) * 2**-52 for _ in range(800)],
        "odd": [0.0, -0.0, math.inf, -math.inf, math.nan, math.nan, 5e-324, -5e-324],
        "one": [3.25],
        None: [rng.random() for _ in range(40)],
    }


@pytest.mark.parametrize(("few", "bins"), [(20_000, 1024), (1, 4), (3, 1024)])
def test_equal_to_percentile(spark, monkeypatch, few, bins):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rows = [(g, v) for g, vs in values(random.Random(1)).items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    show = lambda df: sorted(((r.g, r.n, [repr(x + 0.0) for x in r.q]) for r in df.collect()), key=str)
    want = df.where("v is not null").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q"))
    assert show(quantiles.quantiles(df, ["g"], "v", SHARES)) == show(want)


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert quantiles.quantiles(df, [], "v", [0.1, 0.5]).collect() == [(101, [10.0, 50.0])]
    assert quantiles.quantiles(df.limit(0), [], "v", [0.5]).collect() == []
