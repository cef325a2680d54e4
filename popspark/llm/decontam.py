"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Texts become words (runs of digits, letters and everything beyond ASCII, after
A-Z are lowered). A window is `span` consecutive words of a benchmark item, or a
whole item of fewer; every document word inside an occurrence of a window is a
hit.

Winnowing: each text's hashed k-grams (k words) are looked at through windows of
w = span - k + 1 k-grams, and of each window the minimum is kept. Two texts that
share `span` words share a whole window of k-grams, so they keep the same
minimum: no shared span is missed. Documents and items are cut into segments of
bounded length that overlap by span - 1 words, so that each shared span lies whole in
one of each and a very long text costs no more a word than a short one. Fingerprints
of documents and items are joined; each join hit is extended word by word to
both sides, and counts if `span` words or more agree. Items shorter than `span`
are looked up by their own length (all k-grams of that length, no minimum), all
lengths in one pass.

The item side is broadcast if its rows are at most `broadcast_rows` and their words
at most BROADCAST_CHARS characters, else joined by a shuffle of fingerprints with
their bounded context.

Nulls and edge cases: null and wordless texts have no words, hit nothing and are
never contaminated; items without words have no window; items with a null
item_id are ignored, as a hit on them can't be named; several rows of one
item_id count as one item with all their windows; repeated document rows each
get their row; documents with equal doc_id and different text are apart (a
null doc_id is a value); extra columns are ignored; empty tables give no rows
(documents) or clean rows (benchmark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, split_words

SPAN = 10
K = 5
SEGMENT = 500
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32 << 20
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _gram(words: Column, start: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, start + i) for i in range(k)])


def kgram_hashes(words: Column, k: int) -> Column:
    """The hash of each k-gram, in order; empty if there are fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: _gram(words, i, k))).otherwise(F.array().cast("array<bigint>"))


def _placed_grams(words: Column, m: int) -> Column:
    return F.transform(kgram_hashes(words, m), lambda h, at: F.struct(F.lit(m).alias("m"), at.alias("at"), h.alias("hash")))


def window_minima(hashes: Column, w: int) -> Column:
    """The distinct minima of all windows of w consecutive hashes."""
    n = F.size(hashes)
    minima = F.transform(F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))), lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)]))
    return F.when(n >= w, F.array_distinct(minima)).otherwise(F.array().cast("array<bigint>"))


def _positions(hashes: Column, value: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.get(hashes, i) == value)


def _segments(df: DataFrame, keep: list[str], span: int, segment: int) -> DataFrame:
    """keep, first (the segment's first word's place) and words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("all_words") - span, F.lit(0)), F.lit(segment))
    return df.select(*keep, "all_words", F.explode(starts).alias("first")).select(*keep, "first", F.slice("all_words", F.col("first") + 1, segment + span - 1).alias("words"))


def _around(words: Column, at: Column, k: int, reach: int) -> Column:
    """The words from reach before the k-gram at `at` to reach after it; null outside the text."""
    return F.transform(F.sequence(F.lit(-reach), F.lit(k + reach - 1)), lambda i: F.when(at + i >= 0, F.get(words, at + i)))


def _item_keys(items: DataFrame, span: int, k: int, segment: int) -> DataFrame:
    """width, hash, item_id, around: the winnowed k-grams of long items, whole short items."""
    w = span - k + 1
    words = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text").cast("string")).alias("words")).distinct()
    long = _segments(words.where(F.size("words") >= span).select("item_id", F.col("words").alias("all_words")), ["item_id"], span, segment).withColumn("hashes", kgram_hashes(F.col("words"), k))
    long = long.withColumn("hash", F.explode(window_minima(F.col("hashes"), w))).withColumn("at", F.explode(_positions(F.col("hashes"), F.col("hash"))))
    long = long.select(F.lit(k).alias("width"), "hash", "item_id", _around(F.col("words"), F.col("at"), k, span - k).alias("around"))
    short = words.where(F.size("words").between(1, span - 1))
    hashed = F.lit(None).cast("bigint")
    for m in range(1, span):
        hashed = F.when(F.size("words") == m, _gram(F.col("words"), F.lit(0), m)).otherwise(hashed)
    short = short.select((-F.size("words")).alias("width"), hashed.alias("hash"), "item_id", F.col("words").alias("around"))
    return long.unionByName(short).distinct()


def _extent(left: Column, right: Column, k: int, reach: int) -> tuple[Column, Column]:
    """How many words agree just before and just after an equal k-gram, at most reach each."""
    same = [(F.get(left, F.lit(i)).isNotNull()) & (F.get(left, F.lit(i)) == F.get(right, F.lit(i))) for i in range(2 * reach + k)]
    before = after = F.lit(0)
    for i in range(reach):
        before = F.when(same[i], before + 1).otherwise(0)
        after = F.when(same[2 * reach + k - 1 - i], after + 1).otherwise(0)
    return before, after


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, segment: int = SEGMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, n_words, n_hit, items (sorted item ids), contaminated."""
    reach = span - k
    keys = materialise(_item_keys(benchmark, span, k, segment), "winnow-items")
    widths = [r.width for r in keys.select("width").distinct().collect()]  # at most `span` values
    lengths = sorted(-x for x in widths if x < 0)
    held = keys.agg(F.count("*").alias("rows"), F.sum(F.length(F.array_join("around", " "))).alias("chars")).first()
    small = held.rows <= broadcast_rows and (held.chars or 0) <= BROADCAST_CHARS

    base = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("all_words"))
    parts = _segments(base, ["doc_id", "text_hash"], span, segment)

    found = []
    if k in widths:
        seg = parts.withColumn("hashes", kgram_hashes(F.col("words"), k))
        # The words and hashes of a segment stay with its fingerprints; both are bounded by the segment's length.
        probe = seg.select("doc_id", "text_hash", "first", "words", "hashes", F.explode(window_minima(F.col("hashes"), span - k + 1)).alias("hash"))
        own = keys.where(F.col("width") == k).select(F.col("hash").alias("item_hash"), "item_id", "around")
        if small:
            hits = probe.join(F.broadcast(own), F.col("hash") == F.col("item_hash")).withColumn("at", F.explode(_positions(F.col("hashes"), F.col("hash"))))
        else:
            hits = probe.withColumn("at", F.explode(_positions(F.col("hashes"), F.col("hash")))).select("doc_id", "text_hash", "first", "at", "hash", _around(F.col("words"), F.col("at"), k, reach).alias("doc_around"))
            hits = hits.join(own, F.col("hash") == F.col("item_hash"))
        if small:
            hits = hits.withColumn("doc_around", _around(F.col("words"), F.col("at"), k, reach))
        before, after = _extent(F.col("doc_around"), F.col("around"), k, reach)
        middle = F.forall(F.sequence(F.lit(reach), F.lit(reach + k - 1)), lambda i: F.get(F.col("doc_around"), i) == F.get(F.col("around"), i))
        hits = hits.where(middle).select("doc_id", "text_hash", "item_id", (F.col("first") + F.col("at")).alias("place"), before.alias("before"), after.alias("after"))
        hits = hits.where(F.col("before") + F.col("after") >= reach)
        found.append(hits.select("doc_id", "text_hash", "item_id", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + k + F.col("after")).alias("end")))
    if lengths:
        own = keys.where(F.col("width") < 0).select((-F.col("width")).alias("item_width"), F.col("hash").alias("item_hash"), "item_id", "around")
        grams = F.flatten(F.array(*[_placed_grams(F.col("words"), m) for m in lengths]))
        probe = parts.select("doc_id", "text_hash", "first", "words", F.explode(grams).alias("gram"))
        probe = probe.select("doc_id", "text_hash", (F.col("first") + F.col("gram.at")).alias("start"), "gram.m", "gram.hash", F.slice("words", F.col("gram.at") + 1, F.col("gram.m")).alias("said"))
        same = (F.col("hash") == F.col("item_hash")) & (F.col("m") == F.col("item_width")) & (F.col("said") == F.col("around"))
        hits = probe.join(F.broadcast(own) if small else own, same)
        found.append(hits.select("doc_id", "text_hash", "item_id", "start", (F.col("start") + F.col("m")).alias("end")))

    base = base.select("doc_id", "text_hash", F.size("all_words").cast("long").alias("n_words"))
    if not found:
        return base.select("doc_id", "text_hash", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = materialise(spans.distinct(), "winnow-hits")
    places = spans.select("doc_id", "text_hash", F.explode(F.sequence("start", F.col("end") - 1)).alias("place")).distinct()
    counts = places.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    items = spans.select("doc_id", "text_hash", "item_id").distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    both = counts.join(items, counts.doc_id.eqNullSafe(items.doc_id) & (counts.text_hash == items.text_hash)).select(counts.doc_id.alias("hit_id"), counts.text_hash.alias("hit_hash"), "n_hit", "items")
    out = base.join(both, base.doc_id.eqNullSafe(both.hit_id) & (base.text_hash == both.hit_hash), "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """docs without the rows that share a window with the benchmark."""
    bad = materialise(contamination(docs, benchmark, span).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
