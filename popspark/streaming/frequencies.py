"""Streaming allele counts with retraction (A26, A27 over streams, section 2.15).

A stream of genotype rows (ts, locus, a1, a2, sign) gives allele counts, sign -1
taking a genotype out again. Over event time, watermarked windows are emitted once
they can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allele_rows(stream: DataFrame, *keep: str) -> DataFrame:
    """keep, locus, allele, sign of each present allele."""
    return stream.select(*keep, "locus", "sign", F.explode(F.array("a1", "a2")).alias("allele")).where("allele <> 0")


def running_counts(stream: DataFrame) -> DataFrame:
    """locus, allele, n so far; for complete or update output."""
    return allele_rows(stream).groupBy("locus", "allele").agg(F.sum("sign").alias("n"))


def windowed_counts(stream: DataFrame, width: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """start, locus, allele, n by event-time window, for append output; rows later than `lateness` are left out."""
    rows = allele_rows(stream.withWatermark("ts", lateness), "ts")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "locus", "allele").agg(F.sum("sign").alias("n")).select(F.col("w.start").alias("start"), "locus", "allele", "n")
