"""Allele frequencies and diversity.

Covers A26-A56, P19-P27, P31-P38, E16-E37, X8. Genotypes are rows (ind, locus,
a1, a2) of allele numbers, 0 being absent; an absent pair is a missing genotype, one
absent allele a haploid. All statistics come from counts by (groups, locus, allele),
which Spark sums up partially before its one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popspark.functions.vectors import divide


def present(a1: Column, a2: Column) -> Column:
    """At least one allele is there."""
    return (a1 != 0) | (a2 != 0)


def ploidy(a1: Column, a2: Column) -> Column:
    """0, 1 or 2 alleles."""
    return (a1 != 0).cast("int") + (a2 != 0).cast("int")


def heterozygous(a1: Column, a2: Column) -> Column:
    """Both alleles there and different: a haploid is not."""
    return (a1 != 0) & (a2 != 0) & (a1 != a2)


def heterozygous_labels(left: Column, right: Column) -> Column:
    """The label form, under which a haploid counts as heterozygous (P20)."""
    return ~((left == "") & (right == "")) & (left != right)


def canonical(a1: Column, a2: Column) -> Column:
    """The alleles in order; null if both are absent."""
    return F.when(present(a1, a2), F.struct(F.least(a1, a2).alias("a1"), F.greatest(a1, a2).alias("a2")))


def snp_alleles(code: Column) -> Column:
    """Allele pair of a two-bit code: 0 missing, 1 AA, 2 AB, 3 BB."""
    pair = lambda a, b: F.struct(F.lit(a).alias("a1"), F.lit(b).alias("a2"))
    return F.when(code == 1, pair(1, 1)).when(code == 2, pair(1, 2)).when(code == 3, pair(2, 2))


def dosage(code: Column) -> Column:
    """Copies of the second allele; null if missing (P25)."""
    return F.nullif(code, F.lit(0)) - 1


def unpack_code(packed: Column, ordinal: Column) -> Column:
    """The two-bit code of an individual in a packed column, low bits first."""
    byte = F.conv(F.hex(F.substring(packed, F.floor(ordinal / 4).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(4.0), ordinal % 4)).cast("int") % 4


def pack_codes(codes: DataFrame, by: str, ordinal: str, code: str) -> DataFrame:
    """Two-bit codes of each column as bytes, four to a byte."""
    byte = codes.groupBy(by, F.floor(F.col(ordinal) / 4).alias("at")).agg(F.sum((F.col(code) * F.pow(F.lit(4.0), F.col(ordinal) % 4))).cast("int").alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "b"))), lambda s: F.lpad(F.hex(s["b"]), 2, "0")), "")
    return byte.groupBy(by).agg(F.unhex(text).alias("packed"))


def label(left: Column, right: Column) -> Column:
    """left:right."""
    return F.concat_ws(":", left, right)


def codebook(cells: DataFrame, locus: str, order: str, left: str, right: str) -> DataFrame:
    """locus, allele_index (from 1, by first appearance) and label."""
    seen = cells.select(F.col(locus).alias("locus"), F.col(order).alias("at"), F.posexplode(F.array(left, right)).alias("side", "label")).where("label is not null and label <> ''")
    first = seen.groupBy("locus", "label").agg(F.min(F.struct("at", "side")).alias("first"))
    return first.select("locus", F.row_number().over(Window.partitionBy("locus").orderBy("first")).alias("allele_index"), "label")


def encode(cells: DataFrame, book: DataFrame, locus: str, ind: str, left: str, right: str) -> DataFrame:
    """Cells of labels as genotype rows; an empty or unknown label is 0."""
    a, b = (book.select(F.col("locus").alias(f"l{s}"), F.col("label").alias(f"t{s}"), F.col("allele_index").alias(f"a{s}")) for s in (1, 2))
    out = cells.join(a, (cells[locus] == a["l1"]) & (cells[left] == a["t1"]), "left").join(b, (cells[locus] == b["l2"]) & (cells[right] == b["t2"]), "left")
    return out.select(F.col(ind).alias("ind"), F.col(locus).alias("locus"), F.coalesce("a1", F.lit(0)).alias("a1"), F.coalesce("a2", F.lit(0)).alias("a2"))


def decode(genotypes: DataFrame, book: DataFrame) -> DataFrame:
    """Genotype rows with the labels left and right; '' for 0 or an unknown number."""
    a, b = (book.select(F.col("locus").alias(f"l{s}"), F.col("allele_index").alias(f"i{s}"), F.col("label").alias(f"t{s}")) for s in (1, 2))
    out = genotypes.join(a, (genotypes["locus"] == a["l1"]) & (genotypes["a1"] == a["i1"]), "left").join(b, (genotypes["locus"] == b["l2"]) & (genotypes["a2"] == b["i2"]), "left")
    return out.select(*genotypes.columns, F.coalesce("t1", F.lit("")).alias("left"), F.coalesce("t2", F.lit("")).alias("right"))


def allele_counts(genotypes: DataFrame, *by: str, weight: Column | None = None) -> DataFrame:
    """by, locus, allele, n (A26-A34, A42, E16-E23). weight -1 takes a genotype out again."""
    w = F.lit(1) if weight is None else weight
    rows = genotypes.select(*by, "locus", w.alias("w"), F.explode(F.array("a1", "a2")).alias("allele")).where("allele <> 0")
    return rows.groupBy(*by, "locus", "allele").agg(F.sum("w").alias("n")).where("n <> 0")


def frequencies(genotypes: DataFrame, *by: str) -> DataFrame:
    """by, locus, allele, n, p."""
    whole = Window.partitionBy(*by, "locus")
    return allele_counts(genotypes, *by).withColumn("p", F.col("n") / F.sum("n").over(whole))


def frequencies_of(freqs: DataFrame, alleles: list[int]) -> DataFrame:
    """locus, allele, p of the listed alleles in the caller's order; absent ones are 0."""
    wanted = freqs.select("locus").distinct().select("locus", F.posexplode(F.array(*map(F.lit, alleles))).alias("place", "allele"))
    return wanted.join(freqs.select("locus", "allele", "p"), ["locus", "allele"], "left").select("locus", "place", "allele", F.coalesce("p", F.lit(0.0)).alias("p"))


def heterozygosity_counts(genotypes: DataFrame, *by: str) -> DataFrame:
    """by, locus, genotypes present, heterozygotes; groups whose genotypes are all missing stay, with zeros."""
    a1, a2 = F.col("a1"), F.col("a2")
    return genotypes.groupBy(*by, "locus").agg(F.count_if(present(a1, a2)).alias("genotypes"), F.count_if(heterozygous(a1, a2)).alias("hets"))


def diversity(genotypes: DataFrame, *by: str) -> DataFrame:
    """by, locus, N, A, A95, Ae, Ho, He.

    Without alleles: N, A, A95 and Ae are 0, Ho is NaN and He is 1.
    """
    p = F.col("p")
    f = frequencies(genotypes, *by).groupBy(*by, "locus").agg(F.sum("n").alias("N"), F.count("*").alias("A"), F.count_if(p >= 0.05).alias("A95"), F.sum(p * p).alias("s"))
    h = heterozygosity_counts(genotypes, *by)
    keys = [*by, "locus"]
    out = h.join(f, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*keys, zero("N"), zero("A"), zero("A95"), F.coalesce(1 / F.col("s"), F.lit(0.0)).alias("Ae"), divide(F.col("hets"), F.col("genotypes")).alias("Ho"), (1 - F.coalesce("s", F.lit(0.0))).alias("He"))


def adult_frequencies(genotypes: DataFrame, families: DataFrame) -> DataFrame:
    """Frequencies of the mothers alone."""
    mothers = families.where("mother is not null").select(F.col("mother").alias("ind")).distinct()
    return frequencies(genotypes.join(mothers, "ind", "left_semi"))


def markdown_rows(freqs: DataFrame) -> DataFrame:
    """Each locus as a Markdown table row of its frequencies (K7)."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("allele", "p"))), lambda s: F.format_string("%.4f", s["p"]))
    return freqs.groupBy("locus").agg(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("row"))


def markdown_tables(freqs: DataFrame) -> DataFrame:
    """Header, separator and row (K8)."""
    ordered = F.array_sort(F.collect_list(F.struct("allele", "p")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    grouped = freqs.groupBy("locus").agg(ordered.alias("o"))
    return grouped.select("locus", F.concat_ws("\n", line(F.transform("o", lambda s: s["allele"].cast("string"))), line(F.transform("o", lambda s: F.lit("---"))), line(F.transform("o", lambda s: F.format_string("%.4f", s["p"])))).alias("table"))


def html_rows(freqs: DataFrame) -> DataFrame:
    """Each locus as an HTML table row (K6)."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("allele", "p"))), lambda s: F.concat(F.lit("<td>"), s["p"].cast("string"), F.lit("</td>")))
    return freqs.groupBy("locus").agg(F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>")).alias("row"))
