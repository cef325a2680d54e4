"""Writers of genotype tables (K1, K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.functions.text import natural_key


def genotype_rows(labelled: DataFrame, individuals: DataFrame, strata: DataFrame, loci: list[str]) -> DataFrame:
    """Population, Individual and a left:right cell for each locus (K1); a missing genotype is ':'.

    labelled: ind, locus (name), left, right; strata: ind, stratum. Populations and
    individuals come in natural order.
    """
    cell = F.first(F.concat_ws(":", F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))))
    wide = labelled.groupBy("ind").pivot("locus", loci).agg(cell)
    out = individuals.select("ind", "name").join(strata.select("ind", "stratum"), "ind").join(wide, "ind", "left")
    return out.orderBy(natural_key(F.col("stratum")), "stratum", natural_key(F.col("name")), "name").select(F.col("stratum").alias("Population"), F.col("name").alias("Individual"), *[F.coalesce(F.col(f"`{n}`"), F.lit(":")).alias(n) for n in loci])


def export_genotypes(rows: DataFrame, path: str) -> None:
    """The rows as headed CSV (K1, K2)."""
    rows.write.option("header", True).csv(path)
