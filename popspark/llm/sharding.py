"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash, set apart by a stride (so that copies of a row
are not neighbours), and ranked within their source; row r of a source of n rows gets the fraction (2r + 1) / 2n. All rows in the order of their
fractions (ties by source) form one sequence in which every stretch matches the
mixture, and it is cut into shards whose row counts differ by one at most (the
law is `rows`). The slot is the place within the shard.

Ranks without a task per source: the hash space is cut into bins of about
`bin_rows` rows (all sources together), rows are counted by source and bin, running sums of the counts
give each bin's first rank, and rows are sorted only within their bin. The place
in the whole sequence then follows from the source sizes alone: before row r of a
source of n come, of each source of m rows, those q with (2q + 1) / 2m smaller.
With at most `most_sources` sources this is summed up row by row; with more, rows
are sorted by fraction, again in bins (fractions are evenly spread).

Nulls and edge cases: a null source is a source of its own, ordered last; a null
text has no bytes and crc32 0; a null doc_id hashes as the empty string, and the
text's crc32 is part of the hash, so rows that share a doc_id or have none are
spread like others; rows equal in hash, doc_id and crc32 are ordered by the hash of
the whole row, and rows equal in all of these are interchangeable; extra columns are kept by `assign`, whatever their names, and
earlier columns `shard` and `slot` are replaced; an empty table gives no rows; fewer rows than shards leave the last
shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_hash

SHARDS, SEED, BIN_ROWS, MOST_BINS, MOST_SOURCES = 24, 7, 2000, 100_000, 256


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def shuffled(doc_id: Column, crc: Column, seed: int) -> Column:
    """60 bits of md5 of seed, id and the text's crc32: the place in the seeded shuffle."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), crc.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def assign(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bin_rows: int = BIN_ROWS, most_sources: int = MOST_SOURCES, crc: Column | None = None) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (from 0, gapless within a shard) in place of columns so named.

    crc stands in for the crc32 of `text` where that is known already.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # The row travels as one struct, so none of its names can clash with those used here.
    df = df.select(F.struct(*kept).alias("_row"), F.col("source").cast("string").alias("source"), "doc_id", (text_crc32(F.col("text").cast("string")) if crc is None else crc).alias("_order"), row_hash(df).alias("_last"))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))  # null last
    order = shuffled(F.col("doc_id"), F.col("_order"), seed)
    slim = df.select(source.alias("_source"), order.alias("_hash"))
    total = df.count()
    if not total:
        return df.select("_row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bins = min(-(-total // bin_rows), MOST_BINS)  # a source has a row for each bin in the tables of counts
    bin_of = F.shiftright(F.shiftright(F.col("_hash"), 29) * bins, 31)  # the hash's high 31 bits scaled to the bins
    counts = materialise(slim.withColumn("_bin", bin_of).groupBy("_source", "_bin").agg(F.count("*").alias("_count")), "shard-counts")
    by = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("_source").alias("_s"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_count").over(by), F.lit(0)).alias("_first"))
    sizes = materialise(counts.groupBy("_source").agg(F.sum("_count").alias("_n")), "shard-sizes")
    firsts = materialise(firsts.join(sizes, firsts["_s"] == sizes["_source"]).select("_s", "_b", "_first", "_n"), "shard-firsts")

    keyed = df.withColumn("_source", source).withColumn("_hash", order).withColumn("_bin", bin_of)
    within = Window.partitionBy("_source", "_bin").orderBy("_hash", "doc_id", "_order", "_last")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(firsts, (ranked["_source"] == firsts["_s"]) & (ranked["_bin"] == firsts["_b"])).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_s", "_b", "_first")

    ranked = ranked.withColumn("_rank", _spread(total))

    if sizes.count() <= most_sources:
        place = F.lit(0).cast("long")
        # Products of two row counts: longs while they fit, decimals beyond.
        wide = total > 2_000_000_000
        rank, n = ("cast(_rank as decimal(20, 0))", "cast(_n as decimal(20, 0))") if wide else ("_rank", "_n")
        for name, m in sorted((r["_source"], r["_n"]) for r in sizes.collect()):  # at most most_sources rows
            # How many q >= 0 have (2q + 1) n < (2r + 1) m; for sources before this one equality counts too.
            count = lambda less: F.expr(f"((2 * {rank} + 1) * {m}{'BD' if wide else 'L'} + {n} - {less}) div (2 * {n})")  # noqa: B023, E731
            limit = F.when(F.lit(name) < F.col("_source"), count(0)).otherwise(count(1))
            place = place + F.least(limit, F.lit(m).cast("long"))
        placed = ranked.withColumn("_place", place)
    else:
        placed = _by_sorting(ranked, total, bin_rows)
    big, small = total // shards + 1, total // shards
    long_ones = total % shards
    edge = big * long_ones
    at = F.col("_place")
    past = F.floor((at - edge) / max(small, 1))
    shard = F.when(at < edge, F.floor(at / big)).otherwise(long_ones + past).cast("int")
    slot = F.when(at < edge, at % big).otherwise((at - edge) % max(small, 1)).cast("long")
    return placed.select("_row.*", shard.alias("shard"), slot.alias("slot"))


# Primes just under 2^31, for strides.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579)


def _spread(total: int) -> Column:
    """_rank times a stride, modulo _n: a bijection, as a prime beyond _n has no factor in common with it.

    Copies of one row have one hash and so neighbouring ranks; the stride sets them
    apart. The first prime whose remainder is between a fifth and four fifths of _n
    serves, else the first that does not divide _n.
    """
    fair = [F.when((p % F.col("_n") * 5 >= F.col("_n")) & (p % F.col("_n") * 5 <= 4 * F.col("_n")), p % F.col("_n")) for p in map(F.lit, STRIDES)]
    any_of = [F.when(p % F.col("_n") != 0, p % F.col("_n")) for p in map(F.lit, STRIDES)]
    stride = F.coalesce(*fair, *any_of, F.lit(1)).cast("long")
    if total > 2_000_000_000:
        return (F.col("_rank").cast("decimal(19,0)") * stride.cast("decimal(19,0)") % F.col("_n").cast("decimal(19,0)")).cast("long")
    return F.col("_rank") * stride % F.col("_n")


def _by_sorting(ranked: DataFrame, total: int, bin_rows: int) -> DataFrame:
    """_place by sorting the fractions in bins."""
    bins = min(-(-total // bin_rows), MOST_BINS)
    fraction = (2 * F.col("_rank") + 1).cast("decimal(20,0)") / (2 * F.col("_n")).cast("decimal(20,0)")
    ranked = ranked.withColumn("_fraction", fraction.cast("decimal(38,18)"))
    ranked = ranked.withColumn("_slice", F.floor(F.col("_fraction").cast("double") * bins))
    counts = ranked.groupBy("_slice").agg(F.count("*").alias("_count"))
    by = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialise(counts.select(F.col("_slice").alias("_b"), F.coalesce(F.sum("_count").over(by), F.lit(0)).alias("_first")), "shard-slices")
    within = Window.partitionBy("_slice").orderBy("_fraction", "_source")
    placed = ranked.withColumn("_place", F.row_number().over(within) - 1)
    placed = placed.join(firsts, placed["_slice"] == firsts["_b"])
    return placed.withColumn("_place", F.col("_place") + F.col("_first")).drop("_b", "_first", "_slice", "_fraction")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """df in one folder for each shard, each file in slot order."""
    out = assign(df, **options)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What query op10 returns. Rows are dealt by the law `rows`."""
    text = F.col("text").cast("string")
    slim = docs.select("doc_id", "source", "text").withColumn("size", text_bytes(text) + 8)
    slim = slim.withColumn("text_crc32", text_crc32(text))
    slim = slim.select("doc_id", "source", "size", "text_crc32")
    out = assign(materialise(slim, "shard-rows"), shards, crc=F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
