"""Simulation: mating, founding populations, migration.

Draws come from md5 of a seed and the row's own keys, so a simulation is the same
on every run, partitioning and SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popspark.functions.text import natural_key
from popspark.functions.vectors import hashed_unit

from .stages import numbered


def mate(m1: Column, m2: Column, f1: Column, f2: Column, maternal: Column, paternal: Column) -> Column:
    """left, right and their lineage codes of one offspring, alleles in lexicographic order.

    maternal and paternal are draws in [0, 1). An absent allele ('') of a parent can be passed on.
    """
    mother, father = F.when(maternal < 0.5, m1).otherwise(m2), F.when(paternal < 0.5, f1).otherwise(f2)
    pair = F.array_sort(F.array(F.struct(mother.alias("allele"), F.lit(MATERNAL).alias("lineage")), F.struct(father.alias("allele"), F.lit(PATERNAL).alias("lineage"))))
    return F.struct(pair[0]["allele"].alias("left"), pair[1]["allele"].alias("right"), pair[0]["lineage"].alias("left_lineage"), pair[1]["lineage"].alias("right_lineage"))


def mate_individuals(genotypes: DataFrame, crosses: DataFrame, seed: str) -> DataFrame:
    """Genotypes of crosses (child, mother, father) at every locus of both parents (G46, G47); crosses of unknown parents give nothing.

    genotypes: ind, locus, left, right. A child is named mother:father by its caller.
    """
    m = genotypes.select(F.col("ind").alias("mother"), "locus", F.col("left").alias("m1"), F.col("right").alias("m2"))
    f = genotypes.select(F.col("ind").alias("father"), "locus", F.col("left").alias("f1"), F.col("right").alias("f2"))
    both = crosses.join(m, "mother").join(f, ["father", "locus"])
    draw = lambda side: hashed_unit(seed, side, F.col("child"), F.col("locus"))
    out = mate(F.col("m1"), F.col("m2"), F.col("f1"), F.col("f2"), draw("m"), draw("f"))
    return both.select(F.col("child").alias("ind"), "locus", out.alias("g")).select("ind", "locus", "g.*")


# The lineage codes.
MATERNAL, UNKNOWN, PATERNAL, AMBIGUOUS, IMPOSSIBLE = -1, 0, 1, 2, 3


def set_lineage(left: Column, right: Column, p_left: Column, p_right: Column, from_mother: bool = True) -> Column:
    """Lineages of a diploid's alleles given one parent's genotype (G48); null (unchanged) unless both are diploid.

    The same pair is ambiguous if heterozygous, else one of each. Otherwise the
    left allele is that parent's if it can be, then the right one, the other allele
    being the other parent's. If neither fits both are impossible.
    """
    own, other = (MATERNAL, PATERNAL) if from_mother else (PATERNAL, MATERNAL)
    pair = lambda x, y: F.struct(F.lit(x).alias("left_lineage"), F.lit(y).alias("right_lineage"))
    diploid = (left != "") & (right != "") & (p_left != "") & (p_right != "")
    fits = lambda a: (a == p_left) | (a == p_right)
    equal = (left == p_left) & (right == p_right)
    code = F.when(equal & (left != right), pair(AMBIGUOUS, AMBIGUOUS)).when(equal, pair(MATERNAL, PATERNAL)).when(fits(left), pair(own, other)).when(fits(right), pair(other, own)).otherwise(pair(IMPOSSIBLE, IMPOSSIBLE))
    return F.when(diploid, code)


def pull_parent(genotypes: DataFrame, mothers: DataFrame) -> DataFrame:
    """Lineages at every locus for mothers (ind, mother)."""
    m = genotypes.select(F.col("ind").alias("mother"), "locus", F.col("left").alias("m_left"), F.col("right").alias("m_right"))
    both = genotypes.join(mothers, "ind").join(m, ["mother", "locus"])
    return both.select("ind", "locus", "left", "right", set_lineage(F.col("left"), F.col("right"), F.col("m_left"), F.col("m_right")).alias("l")).select("ind", "locus", "left", "right", "l.*")


def cumulative(freqs: DataFrame) -> DataFrame:
    """locus and steps, the naturally ordered alleles with their cumulative frequencies."""
    by = Window.partitionBy("locus").orderBy(natural_key(F.col("allele").cast("string")), "allele").rowsBetween(Window.unboundedPreceding, 0)
    steps = freqs.select("locus", "allele", F.sum("p").over(by).alias("upto"))
    return steps.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("upto", "allele"))).alias("steps"))


def sample_allele(steps: Column, draw: Column) -> Column:
    """The first allele whose cumulative frequency is above the draw; else the last."""
    hit = F.get(F.filter(steps, lambda s: s["upto"] > draw), F.lit(0))
    return F.coalesce(hit["allele"], F.element_at(steps, -1)["allele"])


def make_population(freqs: DataFrame, name: str, size: int, seed: str) -> DataFrame:
    """ind, locus, left, right of `size` individuals named name-001 on, alleles drawn independently."""
    spark = freqs.sparkSession
    inds = spark.range(1, size + 1).select(F.format_string(f"{name}-%03d", F.col("id")).alias("ind"))
    rows = inds.crossJoin(F.broadcast(cumulative(freqs)))
    draw = lambda side: sample_allele(F.col("steps"), hashed_unit(seed, side, F.col("ind"), F.col("locus")))
    pair = F.array_sort(F.array(draw("l"), draw("r")))
    return rows.select("ind", "locus", pair[0].alias("left"), pair[1].alias("right"))


def random_crosses(parents: DataFrame, count: int, seed: str) -> DataFrame:
    """child, mother, father: parents drawn with replacement, selfing possible."""
    n = parents.count()
    spark = parents.sparkSession
    if not n or count <= 0:
        return spark.createDataFrame([], f"child string, mother {parents.schema['ind'].dataType.simpleString()}, father {parents.schema['ind'].dataType.simpleString()}")
    ranked = numbered(parents.select("ind"), ["ind"], "k")
    pick = lambda side: F.floor(hashed_unit(seed, side, F.col("id")) * n)
    kids = spark.range(count).select(F.concat(F.lit("offspring-"), F.col("id").cast("string")).alias("child"), pick("m").alias("mk"), pick("f").alias("fk"))
    a, b = ranked.select(F.col("ind").alias("mother"), F.col("k").alias("mk")), ranked.select(F.col("ind").alias("father"), F.col("k").alias("fk"))
    return kids.join(a, "mk").join(b, "fk").select("child", "mother", "father")


def random_mate(genotypes: DataFrame, parents: DataFrame, count: int, seed: str) -> DataFrame:
    """Genotypes of `count` offspring."""
    return mate_individuals(genotypes, random_crosses(parents, count, seed), seed)


def apply_migration(individuals: DataFrame, rates: list[tuple[str, str, float]], seed: str) -> DataFrame:
    """individuals (ind, population) after migration at rates (source, destination, rate).

    Sources are worked through in the order they first appear, each on the result of
    the ones before, so immigrants can move on. A destination gets round(rate x
    current size) individuals, held to those left; a source's rates must sum to one.
    Rates are a matrix of populations: few. Each round relabels by one rank.
    """
    order: dict[str, list[tuple[str, float]]] = {}
    for source, destination, rate in rates:
        order.setdefault(source, []).append((destination, rate))
    for source, row in order.items():
        if abs(sum(r for _, r in row) - 1.0) >= 1e-9:
            raise ValueError(f"the rates of {source} sum to {sum(r for _, r in row)}, not 1")
    now = individuals.select("ind", "population")
    for source, row in order.items():
        n = now.where(F.col("population") == source).count()
        cuts, used = [], 0
        for destination, rate in row:
            count = min(int(rate * n + 0.5), n - used) if destination != source and rate > 0 else 0
            if count > 0:
                cuts.append((destination, used + count))
                used += count
        if not cuts:
            continue
        rank = F.row_number().over(Window.partitionBy("population").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit(source), F.col("ind").cast("string"))), "ind"))
        moving = now.where(F.col("population") == source).withColumn("k", rank)
        to = F.lit(source)
        for destination, upto in reversed(cuts):
            to = F.when(F.col("k") <= upto, F.lit(destination)).otherwise(to)
        now = now.where(F.col("population") != source).unionByName(moving.select("ind", to.alias("population")))
    return now
