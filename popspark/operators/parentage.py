"""Maternal families: pollen gametes, pollen pools, correlated paternity.

Covers G12-G20, A53-A56, E31-E35, J11, J12, P36-P38. families is (family, mother), a
null mother being unknown; offspring is (family, offspring, place), place ordering
sibs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.functions.vectors import divide, nan


def paternal_gamete(o1: Column, o2: Column, m1: Column, m2: Column) -> Column:
    """The pollen's share of an offspring (o1, o2) of a mother (m1, m2): status, p1, p2.

    Each offspring allele is a candidate if the mother can have given the other.
    One distinct candidate resolves it, two leave it ambiguous, none is impossible;
    any absent allele is missing.
    """
    in_mother = lambda a: (a == m1) | (a == m2)
    complete = (o1 != 0) & (o2 != 0) & (m1 != 0) & (m2 != 0)
    first, second = in_mother(o2), in_mother(o1)  # o1 is a candidate, o2 is a candidate
    none = F.lit(0).cast("int")
    out = lambda s, a, b: F.struct(F.lit(s).alias("status"), a.cast("int").alias("p1"), b.cast("int").alias("p2"))
    return (
        F.when(~F.coalesce(complete, F.lit(False)), out("missing", none, none))
        .when(first & second & (o1 != o2), out("ambiguous", F.least(o1, o2), F.greatest(o1, o2)))
        .when(first, out("resolved", o1, none))
        .when(second, out("resolved", o2, none))
        .otherwise(out("impossible", none, none))
    )


def gametes(genotypes: DataFrame, families: DataFrame, offspring: DataFrame, with_unknown: bool = True) -> DataFrame:
    """family, offspring, place, locus, status, p1, p2 for every offspring and locus.

    An unknown mother or a genotype that is not there counts as missing; without
    with_unknown, families without a mother are left out.
    """
    fam = families if with_unknown else families.where("mother is not null")
    loci = genotypes.select("locus").distinct()
    kids = offspring.join(fam, "family").crossJoin(F.broadcast(loci))
    o = genotypes.select(F.col("ind").alias("offspring"), "locus", F.col("a1").alias("o1"), F.col("a2").alias("o2"))
    m = genotypes.select(F.col("ind").alias("mother"), "locus", F.col("a1").alias("m1"), F.col("a2").alias("m2"))
    both = kids.join(o, ["offspring", "locus"], "left").join(m, ["mother", "locus"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("family", "offspring", "place", "locus", paternal_gamete(zero("o1"), zero("o2"), zero("m1"), zero("m2")).alias("g")).select("family", "offspring", "place", "locus", "g.status", "g.p1", "g.p2")


def pollen_tallies(pollen: DataFrame, *by: str) -> DataFrame:
    """by, locus and how many gametes were resolved, ambiguous, impossible, missing."""
    return pollen.groupBy(*by, "locus").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "ambiguous", "impossible", "missing")])


def pollen_counts(pollen: DataFrame, *by: str) -> DataFrame:
    """by, locus, allele, n: 1 for a resolved gamete, a half for each side of an ambiguous one."""
    half = lambda c: F.struct(F.col(c).alias("allele"), F.lit(0.5).alias("w"))
    sides = F.when(F.col("status") == "resolved", F.array(F.struct(F.col("p1").alias("allele"), F.lit(1.0).alias("w")))).when(F.col("status") == "ambiguous", F.array(half("p1"), half("p2")))
    return pollen.select(*by, "locus", F.explode(sides).alias("s")).groupBy(*by, "locus", F.col("s.allele").alias("allele")).agg(F.sum("s.w").alias("n"))


def pollen_pool(pollen: DataFrame, *by: str) -> DataFrame:
    """by, locus, N, He, Ae of the pollen pool and its tallies."""
    keys = [*by, "locus"]
    whole = pollen_counts(pollen, *by).groupBy(*keys).agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    s = F.col("nn") / (F.col("N") * F.col("N"))
    return pollen_tallies(pollen, *by).join(whole, keys, "left").select(*keys, F.coalesce("N", F.lit(0.0)).alias("N"), (1 - F.coalesce(s, F.lit(0.0))).alias("He"), F.coalesce(1 / s, F.lit(0.0)).alias("Ae"), "resolved", "ambiguous", "impossible", "missing")


def pollen_frequencies(pollen: DataFrame, *by: str) -> DataFrame:
    """by, locus, allele, n, p."""
    counts = pollen_counts(pollen, *by)
    totals = counts.groupBy(*by, "locus").agg(F.sum("n").alias("whole"))
    return counts.join(totals, [*by, "locus"]).select(*by, "locus", "allele", "n", (F.col("n") / F.col("whole")).alias("p"))


def match_probability(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Chance that two gametes (status, p1, p2) carry the same allele; null if either is missing or impossible.

    Each gamete is a fair draw among its one or two alleles.
    """
    sides = lambda g: F.when(g["status"] == "resolved", F.array(g["p1"])).when(g["status"] == "ambiguous", F.array(g["p1"], g["p2"]))
    x, y = sides(a), sides(b)
    equal = F.aggregate(x, F.lit(0), lambda s, v: s + F.size(F.filter(y, lambda w: w == v)))
    return F.when(x.isNotNull() & y.isNotNull(), equal / (F.size(x) * F.size(y)))


def correlated_paternity(pollen: DataFrame, *by: str) -> DataFrame:
    """by (family, or nothing for all), rp, pairs, donors.

    rp = sum(match - S) / sum(1 - S) over the pairs of sibs at each locus, S being
    the identity of the whole pollen pool there; donors = 1 / rp if rp > 0, else
    null; without informative pairs rp is NaN. pollen comes from families with a
    known mother.

    Pairs are not listed: sibs are grouped by their gamete first, and a pair of
    gametes stands for the product of its counts.
    """
    pool = pollen_counts(pollen).groupBy("locus").agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("S"))
    kinds = pollen.where("status in ('resolved', 'ambiguous')").groupBy("family", "locus", "status", "p1", "p2").agg(F.count("*").alias("n"))
    x, y = kinds.alias("x"), kinds.alias("y")
    order = F.struct("x.status", "x.p1", "x.p2") <= F.struct("y.status", "y.p1", "y.p2")
    both = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.locus") == F.col("y.locus")) & order)
    same = (F.col("x.status") == F.col("y.status")) & (F.col("x.p1") == F.col("y.p1")) & (F.col("x.p2") == F.col("y.p2"))
    pairs = F.when(same, F.col("x.n") * (F.col("x.n") - 1) / 2).otherwise(F.col("x.n") * F.col("y.n"))
    side = lambda t: {c: F.col(f"{t}.{c}") for c in ("status", "p1", "p2")}
    rows = both.select(F.col("x.family").alias("family"), F.col("x.locus").alias("locus"), pairs.alias("pairs"), match_probability(side("x"), side("y")).alias("match")).where("pairs > 0")
    rows = rows.join(F.broadcast(pool), "locus")
    sums = rows.groupBy(*by).agg(F.sum(F.col("pairs") * (F.col("match") - F.col("S"))).alias("num"), F.sum(F.col("pairs") * (1 - F.col("S"))).alias("den"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"))
    rp = F.when(F.col("den") > 0, divide(F.col("num"), F.col("den"))).otherwise(nan())
    return sums.select(*by, rp.alias("rp"), "pairs").withColumn("donors", F.when((F.col("rp") > 0) & ~F.isnan("rp"), 1 / F.col("rp")))


def mothers(families: DataFrame) -> DataFrame:
    """Known mothers."""
    return families.where("mother is not null").select("mother")


def family(families: DataFrame, name) -> DataFrame:
    """P36."""
    return families.where(F.col("family") == name)


def offspring_of(offspring: DataFrame, families: DataFrame) -> DataFrame:
    """All offspring in family order."""
    return offspring.join(families, "family", "left_semi")
