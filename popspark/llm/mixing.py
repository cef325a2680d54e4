"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target in words: its weight's share of the budget, at most
`most_epochs` times its size, with what is above reshared by weight among the
others until none is above (one level L with sum(min(cap, L x weight)) = budget).
A source is first taken whole as often as its target allows; the rest of the
target is a weighted sample without replacement: each document's key is an
exponential variate divided by its quality weight, keys are sorted within the
source and sizes are summed up in that order to the rest.

Prefix sums of a source of any size: keys are put in 128 x 128 bins of equal
probability for weight 1. Sums of the 128 coarse bins find the bin in which the
rest runs out, sums of its 128 fine bins narrow it, and only that fine bin (about
1/16384 of the source) is sorted in one place. No task holds a source. Variates
come from md5 of seed, doc_id and text hash, so reruns and retried tasks agree.

The document at which the sum passes the rest is taken if more than half of it
fits, so a source ends within half a document of its target.

Nulls and edge cases: null text has size 0 and is taken as often as its source is
whole, or once more if its key comes before the cut; a null source is one source, ordered last; a null or non-positive weight
counts as 1; equal keys are ordered by doc_id; repeated rows draw the same key and
are ordered arbitrarily among themselves, each counted; an empty table gives no
rows; extra columns are kept by `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_unit, materialise, row_hash, split_words

SHARE, MOST_EPOCHS, SEED, BINS = 1.5, 2, "mix-1", 128
WEIGHTS = (5.0, 2.0, 1.0)


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def targets(sizes: DataFrame, share: float = SHARE, most_epochs: int = MOST_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for the rows (source, source_size), one for each source.

    This table has one row a source, so one task may order it.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size"))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filled.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    # With the sources before this one at their caps, the level that the others share.
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    capped = F.col("level") * F.col("weight") > F.col("cap")
    level = F.min(F.when(~capped, F.struct("cap_order", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    ranked = ranked.withColumn("cap_order", F.row_number().over(filled)).withColumn("final", level)
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _prefix(df: DataFrame, bin_name: str) -> DataFrame:
    """Words before each bin of its source; a source has at most BINS rows here."""
    sums = df.groupBy("source", bin_name).agg(F.sum("size").alias("bin_size"), F.min("rest").alias("rest"), F.min("offset").alias("offset"))
    by = Window.partitionBy("source").orderBy(bin_name)
    before = F.coalesce(F.sum("bin_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("offset")
    return sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") >= F.col("rest")))


def plan(rows: DataFrame, share: float = SHARE, most_epochs: int = MOST_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, text_hash, size, source, source_size, target and copies for rows (doc_id, source, size, text_hash, quality)."""
    quality = F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(1.0))
    key = -F.log(hash_unit(seed, F.col("doc_id"), F.col("text_hash"))) / quality
    keyed = rows.withColumn("key", key).withColumn("spot", 1 - F.exp(-F.col("key")))
    fine = F.least(F.floor(F.col("spot") * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")
    keyed = keyed.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / BINS).cast("int")).drop("spot")
    keyed = materialise(keyed, "mix-keys")
    sources = targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), share, most_epochs, weights)
    # Whole epochs; a target at its cap is all whole.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    sources = sources.withColumn("epochs", whole).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    sources = materialise(sources, "mix-sources")

    def onto(df: DataFrame, side: DataFrame, *names: str) -> DataFrame:
        side = side.select(F.col("source").alias("side_source"), *names)
        return df.join(side, df["source"].eqNullSafe(side["side_source"]), "left").drop("side_source")

    start = onto(keyed, sources.withColumn("offset", F.lit(0).cast("long")), "rest", "offset")
    cut = materialise(_prefix(start, "coarse").select("source", F.col("coarse").alias("cut_coarse"), "before", "rest"), "mix-coarse")
    inside = onto(keyed, cut, "cut_coarse", "before", "rest").where("coarse = cut_coarse").withColumnRenamed("before", "offset")
    cut2 = materialise(_prefix(inside, "fine").select("source", F.col("fine").alias("cut_fine"), F.col("before").alias("fine_before"), "rest"), "mix-fine")
    last = onto(keyed, cut2, "cut_fine", "fine_before", "rest").where("fine = cut_fine")
    by = Window.partitionBy("source").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum("size").over(by), F.lit(0)) + F.col("fine_before"))
    extra = F.when(F.col("before") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    last = last.withColumn("extra", extra)

    out = onto(onto(keyed, sources, "source_size", "target", "epochs", "rest"), cut2, "cut_fine")
    rest_of = out.where("not (fine <=> cut_fine)").withColumn("extra", F.when((F.col("rest") > 0) & (F.coalesce(F.col("fine") < F.col("cut_fine"), F.lit(False))), 1).otherwise(0))
    edge = onto(last.drop("rest"), sources, "source_size", "target", "epochs")
    names = ["doc_id", "text_hash", "size", "source", "source_size", "target", (F.col("epochs") + F.col("extra")).alias("copies")]
    return rest_of.select(*names).unionByName(edge.select(*names))


def prepare(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows `plan` needs. Quality: 2 for a good label, 0.5 for a bad one, 1 without label."""
    rows = docs.select("doc_id", "source", F.size(split_words(F.col("text").cast("string"))).cast("long").alias("size"), text_hash(F.col("text")).alias("text_hash"))
    if labels is None:
        return rows.withColumn("quality", F.lit(1.0))
    best = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("label"))
    quality = F.when(F.col("label") >= 1, 2.0).when(F.col("label") < 1, 0.5).otherwise(1.0)
    return rows.join(best, rows["doc_id"] == best["label_id"], "left").select("doc_id", "source", "size", "text_hash", quality.alias("quality"))


#: A row that is due more often is repeated in pieces of so many.
REPEATS = 10_000


def mix(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """docs, each row as often as the mix takes it (columns of docs only).

    Rows equal in doc_id, text and source share what these rows take together; of
    what does not divide evenly, the rows with the smallest row_hash get one more.
    """
    taken = plan(prepare(docs, labels), **options).groupBy(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash"), F.col("source").alias("mix_source"))
    chosen = materialise(taken.agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows")).where("mix_copies > 0"), "mix-chosen")
    # The row travels as one struct, so none of its names can clash with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("mix_row"), F.col("doc_id").alias("own_id"), text_hash(F.col("text")).alias("own_hash"), F.col("source").alias("own_source"), row_hash(docs).alias("own_row"))
    same = F.col("own_id").eqNullSafe(F.col("mix_id")) & (F.col("own_hash") == F.col("mix_hash")) & F.col("own_source").eqNullSafe(F.col("mix_source"))
    out = rows.join(chosen.where("mix_rows = 1"), same).select("mix_row", F.col("mix_copies").alias("times"))
    shared = chosen.where("mix_rows > 1")
    if shared.limit(1).count():
        key = ["own_id", "own_hash", "own_source"]
        met = rows.join(shared, same)
        alike = met.groupBy(*key, "own_row").agg(F.count("*").alias("alike"), F.min("mix_copies").alias("copies"), F.min("mix_rows").alias("rows"))
        before = F.coalesce(F.sum("alike").over(Window.partitionBy(*key).orderBy("own_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        extra = F.least(F.greatest(F.expr("copies % rows") - before, F.lit(0)), F.col("alike"))
        due = alike.select(F.col("own_id").alias("mix_id"), F.col("own_hash").alias("mix_hash"), F.col("own_source").alias("mix_source"), F.col("own_row").alias("due_row"), (F.expr("copies div rows") * F.col("alike") + extra).alias("times"))
        once = rows.join(due.where("times > 0"), same & (F.col("own_row") == F.col("due_row"))).dropDuplicates([*key, "own_row"])
        out = out.unionByName(once.select("mix_row", "times"))
    pieces = out.select("mix_row", "times", F.explode(F.sequence(F.lit(0), F.expr(f"(times - 1) div {REPEATS}"))).alias("piece"))
    return pieces.select("mix_row", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(REPEATS), F.col("times") - F.col("piece") * REPEATS).cast("int")))).select("mix_row.*")
