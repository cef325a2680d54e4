"""Near copies by words: SimHash links that are confirmed and completed, so that they are all
rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's words (ASCII lower case) give 5-word shingles, repeats dropped; a text
of one to four words is one shingle. A shingle is known by a 48-bit hash, a set
by the XXH64 of its sorted hashes, its key; texts with equal sets fold into one key.

Candidates by fingerprint: each token of a set, mixed to 64 bits, votes on the bits of
its SimHash. The operator of simhash files the fingerprints by equal bytes and
compares them by bit planes; pairs within its wide radius are compared on the
whole sets, and the similar ones are linked. No radius that can be filed finds all: of
the similar pairs in 8,000 texts with many edited copies most are 7 to 18 bits apart.

Candidates for the rest: with the tokens of all sets in one order, two sets that similar share
a token among the first n - ceil(0.8 n) + 1 of each, so sets that share none are
never compared and no similar pair is missed. Any order is right; tokens often
met in a sample of the sets come last, so few sets meet at a common line.
Sets that meet at a token are a bucket. Pairs are compared in three rounds, each
merging the components of the links found so far:
1. those of fingerprints, and each set with the first of those with its own fingerprint;
2. in buckets that hold several components, each set outside the largest of them
   with the NEAREST sets of other components, by sketches;
3. in buckets that still do, all pairs of different components that sketches allow.
After the third round no similar pair has its sets in different components, and no
group of near copies has been listed pair by pair.

A sketch is a power of two of bits, about four to eight a token, bit b being the
parity of the number of tokens with that remainder; halves laid over each other by
XOR give the sketch of half the length. Two sketches of one length differ in no more
bits than the sets in tokens, and similar sets differ in at most a ninth of their
sizes' sum, so no similar pair is lost by sketches. Within buckets SKETCH bits are
compared, then the whole sketches of the pairs left, then the sets of those left.

Nulls and edge cases: null and wordless texts have the empty set and are copies
of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_scratch, majority, row_hash, scratch

SHINGLE = 5
SEED = 42
#: Least bits of a sketch, and those compared within buckets.
SKETCH = 1024
#: Similarity in fifths, so that all comparisons are of integers.
FIFTHS = 4
#: Sets of other components that a set is compared with in the second round; sketches compared at a time, and pairs of them.
NEAREST, ROWS, CELLS = 2, 256, 1 << 19
#: A set in SAMPLE is counted for the order; a token met LEAST_MET times there is common; so many common tokens are kept.
SAMPLE, LEAST_MET, MOST_COMMON = 8, 3, 1_000_000
#: Up to so many keys of candidates are broadcast to pick their sets; more are joined by shuffle.
MOST_SENT = 1_000_000

_FOLD = str.maketrans(UPPER, LOWER)
_BREAKS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}
_MIX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 48-bit hashes of one text's shingles."""
    words = [w for w in (text or "").translate(_FOLD).translate(_BREAKS).split(" ") if w]
    if not words:
        return np.array([], np.int64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(" ".join(words).encode("utf-8", "replace"), SEED) >> 16], np.int64)
    each = np.fromiter((digest(w.encode("utf-8", "replace"), SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for i, m in enumerate(_MIX):
        out = (out ^ (out >> np.uint64(29))) * _MIX[0] + each[i : i + n] * m
    out = (out ^ (out >> np.uint64(32))) * _MIX[1]
    return np.unique((out ^ (out >> np.uint64(29))) >> np.uint64(16)).view(np.int64)


def set_key(tokens: np.ndarray) -> int:
    """The signed 64-bit key of a set."""
    x = xxhash.xxh64_intdigest(tokens.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def fingerprint(tokens: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set; zero for the empty set."""
    x = tokens.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _MIX[2]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    fp = majority(x ^ (x >> np.uint64(32)))
    return fp - (1 << 64) if fp >> 63 else fp


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens for each remainder, packed into longs."""
    bits = max(SKETCH, 1 << (4 * len(tokens)).bit_length())
    odd = np.bincount(tokens & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(words: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """A sketch at a smaller length."""
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"), F.col("text").cast("string").alias("text"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, tokens) of the texts; tokens are null but for the first row of a key in a task."""
    seen: set[int] = set()
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        keys = [set_key(x) for x in sets]
        first = [x if k not in seen and not seen.add(k) else None for k, x in zip(keys, sets, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["key", "n", "tokens"])


def _common(docs: DataFrame) -> Broadcast:
    """The tokens often met in a sample of the rows, sorted, and how often: a hint for the order."""
    sampled = _slim(docs).where(F.pmod("row_hash", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_whole, "key long, n int, tokens array<long>")
    met = sampled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("met"))
    found = met.where(F.col("met") >= LEAST_MET).orderBy(F.desc("met"), "token").limit(MOST_COMMON).toArrow()
    tokens, counts = found.column("token").to_numpy(), found.column("met").to_numpy()
    order = np.argsort(tokens)
    return docs.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))


def _prefix(x: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens by which a set has to be found."""
    if not len(x):
        return x
    met = np.zeros(len(x), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
        met = np.where(tokens[at] == x, counts[at], 0)
    return x[np.lexsort((x, met))[: len(x) - (FIFTHS * len(x) + 4) // 5 + 1]]


def _prefixes(common: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = common.value
        seen: set[int] = set()
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            keys = [set_key(x) for x in sets]
            new = [k not in seen and not seen.add(k) for k in keys]
            first = [_prefix(x, tokens, counts) if f else None for f, x in zip(new, sets, strict=True)]
            marks = [sketch(x) if f else None for f, x in zip(new, sets, strict=True)]
            short = [folded(x) if x is not None else None for x in marks]
            fps = [fingerprint(x) if f else None for f, x in zip(new, sets, strict=True)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(keys, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(first, longs), pa.array(marks, longs), pa.array(short, longs), pa.array(fps, pa.int64())], names=["doc_id", "row_hash", "key", "n", "prefix", "whole", "sketch", "fp"])

    return run


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, key, n, prefix, whole sketch, sketch of SKETCH bits and fingerprint for each row; the last four are null but for the first row of a key in a task."""
    return _slim(docs).mapInArrow(_prefixes(_common(docs)), "doc_id long, row_hash long, key long, n int, prefix array<long>, whole array<long>, sketch array<long>, fp long")


def bucket_pairs(roots: np.ndarray, keys: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, nearest: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's keys (smaller first) in different components that sketches allow: for each member
    outside the largest component with the nearest others, or with all others if nearest is None."""
    names, counts = np.unique(roots, return_counts=True)
    outside = np.flatnonzero(roots != names[np.argmax(counts)])
    step = max(1, min(ROWS, CELLS // len(keys)))
    for at in range(0, len(outside), step):
        rows = outside[at : at + step]
        differ = np.zeros((len(rows), len(keys)), np.int64)
        for word in range(sketches.shape[1]):
            differ += np.bitwise_count(sketches[rows, word][:, None] ^ sketches[None, :, word])
        far = ((5 + FIFTHS) * differ > (5 - FIFTHS) * (sizes[rows][:, None] + sizes[None, :])) | (roots[rows][:, None] == roots[None, :])
        if nearest is not None and len(keys) > nearest:
            differ[far] = 1 << 40
            best = np.argpartition(differ, nearest - 1, axis=1)[:, :nearest]
            keep = np.zeros_like(far)
            np.put_along_axis(keep, best, True, axis=1)
            far |= ~keep
        i, j = np.nonzero(~far)
        yield np.minimum(keys[rows[i]], keys[j]), np.maximum(keys[rows[i]], keys[j])


def _bucket_pairs(nearest: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                m = pa.RecordBatch.from_struct_array(members.values)
                sketches = m.column("sketch").flatten().to_numpy().view(np.uint64).reshape(m.num_rows, -1)
                for a, b in bucket_pairs(*(m.column(x).to_numpy() for x in ("root", "key", "n")), sketches, nearest):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that their sizes and whole sketches allow to be similar."""
    left, right = [sketches.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("whole").alias(f"whole_{x}")) for x in "ab"]
    length = F.least(F.size("whole_a"), F.size("whole_b"))

    def fold(x: str) -> Column:
        halves = F.zip_with(F.slice(x, 1, length), F.slice(F.col(x), length + 1, length), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > length, halves).otherwise(F.col(x))

    # Sizes that fit are within a quarter, so one sketch is at most twice as long as the other.
    fits = 5 * F.least("n_a", "n_b") >= FIFTHS * F.greatest("n_a", "n_b")
    differ = F.aggregate(F.zip_with(fold("whole_a"), fold("whole_b"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)
    return pairs.join(left, "a").join(right, "b").where(fits).where((5 + FIFTHS) * differ <= (5 - FIFTHS) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar; the sets are made again from one row of each."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    few = keys.limit(MOST_SENT + 1).count() <= MOST_SENT
    rows = sets.join(F.broadcast(keys) if few else keys, "key", "left_semi").groupBy("key").agg(F.min("row_hash").alias("picked")).select("picked")
    texts = _slim(docs).join(F.broadcast(rows) if few else rows, F.col("row_hash") == F.col("picked"), "left_semi").select("text")
    full = texts.mapInArrow(_whole, "key long, n int, tokens array<long>").where("tokens is not null").dropDuplicates(["key"])
    left, right = full.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), full.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) * (5 + FIFTHS) >= FIFTHS * (F.col("na") + F.col("nb"))).select("a", "b")


def fingerprint_candidates(sketches: DataFrame, filed: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints are near: near gives such pairs of filed (fp, first key, keys); sets of one fingerprint pair with its first."""
    same = sketches.join(filed.where("keys > 1").select("fp", "first"), "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    left, right = [filed.select(F.col("fp").alias(x), F.col("first").alias(f"key_{x}")) for x in "ab"]
    linked = near(filed).join(left, "a").join(right, "b")
    return same.unionByName(linked.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))).distinct()


def similar_keys(sets: DataFrame, docs: DataFrame, near: Callable[[DataFrame], DataFrame], components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) for the keys of sets (of docs) that are similar to others; near finds pairs (a, b) of the column fp, components does that for links (a, b)."""
    spark = sets.sparkSession
    used = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(scratch(spark, name))
        df.write.parquet(used[-1])
        return spark.read.schema(df.schema).parquet(used[-1])

    sketches = keep(sets.where("sketch is not null").select("key", "n", "whole", "sketch", "fp").dropDuplicates(["key"]), "similar-sketches")
    filed = keep(sketches.where("n > 0").groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("keys")), "similar-fingerprints")
    tested = keep(_close(fingerprint_candidates(sketches.where("n > 0"), filed, near), sketches), "similar-pairs")
    links = keep(_similar(tested, sets, docs), "similar-links")
    roots = keep(components(links), "similar-roots")
    # Few tokens repeat within a task, so rows go to their token as they are: gathering them first would only make them longer.
    at = sets.where("n > 0").select(F.explode("prefix").alias("token"), "key").repartition("token")
    found = at.groupBy("token").agg(F.collect_set("key").alias("members")).where(F.size("members") > 1)
    found = found.select(F.sort_array("members").alias("members")).select("members", F.xxhash64("members").alias("bucket")).dropDuplicates(["bucket"])
    each = keep(found.select("bucket", F.explode("members").alias("key")), "similar-buckets")
    for nearest in (NEAREST, None):
        named = each.join(roots, each.key == roots.node, "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
        apart = keep(named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "similar-apart")
        members = named.join(apart, "bucket", "left_semi").join(sketches.select("key", "n", "sketch"), "key").groupBy("bucket").agg(F.collect_list(F.struct("root", "key", "n", "sketch")).alias("members"))
        new = keep(members.select("members").mapInArrow(_bucket_pairs(nearest), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"), "similar-pairs")
        more = keep(_similar(keep(_close(new, sketches), "similar-close"), sets, docs), "similar-links")
        tested, links = tested.unionByName(new), links.unionByName(more)
        if more.limit(1).count():
            roots = keep(components(links), "similar-roots")
    out = scratch(spark, "similar-components")
    roots.write.parquet(out)
    for path in used:
        drop_scratch(spark, path)
    return spark.read.parquet(out)
