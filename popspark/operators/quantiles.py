"""Exact quantiles by histogram refinement, for all groups and shares at once.

A quantile interpolates between two order statistics. These are looked for in counts
of bins: first by sign and binary exponent, then each bin that holds one is cut into
BINS equal parts, until the bins concerned hold few rows or one value. Buffers are a
row a group and bin, of fixed number, however many different values there are; only
what lies in the bins concerned is looked at again, and at last ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import saved

#: Parts of a bin, and rows of a bin that are ranked instead of cut.
BINS, FEW = 1024, 20_000


def _exponent(v: Column) -> Column:
    """A whole number that grows with v: its sign with its binary exponent; NaN is above all."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1200
    return F.when(F.isnan(v), 4000).when(v == float("inf"), 3000).when(v == float("-inf"), -3000).when(v > 0, size).when(v < 0, -size).otherwise(0)


def _located(bins: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """wanted (on, rank) with the bin each rank falls into: lo, hi, n, and the rank within it."""
    before = Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    upto = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = upto.withColumnsRenamed({c: f"_{c}" for c in on})
    same = [wanted[c].eqNullSafe(held[f"_{c}"]) for c in on]
    found = wanted.join(held, [*same, (F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("n"))])
    return found.drop(*[f"_{c}" for c in on]).withColumn("within", F.col("within") - F.col("before")).drop("before", "bin")


def _inside(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """The rows that lie in ranges (by, lo, hi), with lo and hi."""
    held = ranges.select(*[F.col(c).alias(f"_{c}") for c in by], "lo", "hi").distinct()
    return rows.join(held, [*[rows[c].eqNullSafe(held[f"_{c}"]) for c in by], (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))]).drop(*[f"_{c}" for c in by])


def order_statistics(rows: DataFrame, wanted: DataFrame, bins: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, value of the wanted ranks (from 0) among the rows' v; bins are the counts by exponent."""
    at = saved(_located(bins, wanted.withColumn("within", F.col("rank")), by), "quantiles")
    settled = F.col("lo").eqNullSafe(F.col("hi"))
    done = at.where(settled).select(*by, "rank", F.col("lo").alias("value"))
    while True:
        still = at.where(~settled)
        most = still.agg(F.max("n")).first()[0]
        if most is None:
            return done
        if most <= FEW:
            # FEW rows a range at most.
            ranked = _inside(rows, still, by).withColumn("within", F.row_number().over(Window.partitionBy(*by, "lo").orderBy("v")) - 1)
            held = ranked.withColumnsRenamed({c: f"_{c}" for c in [*by, "lo", "within"]})
            last = still.join(held, [still[c].eqNullSafe(held[f"_{c}"]) for c in [*by, "lo", "within"]])
            return done.unionByName(last.select(*by, "rank", F.col("v").alias("value")))
        part = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"))
        cut = _inside(rows, still, by).groupBy(*by, F.col("lo").alias("of"), part.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        at = saved(_located(cut, still.select(*by, "rank", F.col("lo").alias("of"), "within"), [*by, "of"]).drop("of"), "quantiles")
        done = done.unionByName(at.where(settled).select(*by, "rank", F.col("lo").alias("value")))


def at_ranks(df: DataFrame, by: list[str], value: str | Column, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """by, n and values: for each group its number of values, and those at the ranks (from 0) that `ranks` gives for that number; no row for a group without values."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, v.alias("v")).where(F.col("v").isNotNull())
    bins = saved(rows.groupBy(*by, _exponent(F.col("v")).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "bins")
    groups = bins.groupBy(*by).agg(F.sum("n").alias("total")).where("total is not null")
    asked = groups.select(*by, "total", F.posexplode(F.array(*ranks(F.col("total")))).alias("at", "rank"))
    found = saved(order_statistics(rows, asked.select(*by, "rank").distinct(), bins, by), "order-statistics")
    held = found.withColumnsRenamed({c: f"_{c}" for c in [*by, "rank"]})
    both = asked.join(held, [asked[c].eqNullSafe(held[f"_{c}"]) for c in [*by, "rank"]])
    return both.groupBy(*by, F.col("total").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def quantiles(df: DataFrame, by: list[str], value: str | Column, shares: list[float]) -> DataFrame:
    """by, n and q: for each group its number of values and the quantile of each share, interpolated between neighbours; no row for a group without values."""
    places = lambda n: [(n - 1) * F.lit(float(s)) for s in shares]
    ends = at_ranks(df, by, value, lambda n: [f(p).cast("long") for p in places(n) for f in (F.floor, F.ceil)])

    def between(k: int, p: Column) -> Column:
        one, two = F.get("values", F.lit(2 * k)), F.get("values", F.lit(2 * k + 1))
        return F.when((p == F.floor(p)) | (one == two), one).otherwise((F.ceil(p) - p) * one + (p - F.floor(p)) * two)

    return ends.select(*by, "n", F.array(*[between(k, p) for k, p in enumerate(places(F.col("n")))]).alias("q"))
