"""Near-duplicate detection: SimHash fingerprints, linked by bit-sliced comparison.

A text's words (ASCII lower case) give 3-word shingles, repeats included. Each
shingle's XXH64 votes on 64 bits. Fingerprints that differ in at most `radius`
bits are linked, and the connected components of the links are the groups.

Candidates: the 64 bits are cut into 8 bytes. Two fingerprints within 2 bits
agree on at least 6 of the 8 bytes, so each distinct fingerprint is filed under
all C(8, 2) = 28 choices of 6 bytes. A file holds at most 2**16 distinct
fingerprints whatever the corpus, as only 16 bits are left to differ, so none
needs a cap. Copies of a text share a fingerprint and are folded before filing.

Within a file the left bits are stored as bit planes: plane b has bit b of all
members, packed into 64-bit words. For a set of query members all distances
grow together: a plane XOR the query's bit is added into a carry-save counter of
two bit vectors and an overflow vector, and a block of queries is abandoned
once no member is within the radius.

The pipeline's near-dedup (keep_first) uses the same files and planes with the
fingerprints of similar, at WIDE bits: two fingerprints within 6 bits agree on at
least 2 bytes, so there are 28 choices again, and a third counter. Its pairs are
confirmed on the whole sets of shingles, and what fingerprints can't find is added
(see similar).

Nulls and edge cases: a null or wordless text has fingerprint zero and is
linked like any other; a text of one or two words is one shingle; repeated
rows stay, each with its group's id; a null doc_id stays a row and never is a
component id unless its group has no other id (then null); an empty table
gives no rows; other columns are kept only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import LOWER, SPACE_RUN, UPPER, drop_scratch, majority, materialise, row_hash, scratch

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Query members compared at a time: bounds a block's memory at 512 x 2**16 bits.
QUERY_BLOCK = 512
#: Bits that fingerprints of near copies may differ in; files of so many members or fewer, one word of a plane, are compared side by side.
WIDE, SMALL = 6, 64

_FOLD = str.maketrans(UPPER, LOWER)
_BREAKS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").translate(_FOLD).translate(_BREAKS).split(" ")
    words = [w.encode("utf-8", "replace") for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return majority(hashes)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and its signed 64-bit fingerprint fp, a row for each row of docs."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long")


class BitPlanes:
    """Distinct fingerprints, stored as one packed bit vector for each bit."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.words = -(-len(fps) // 64)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.used = [b for b in range(64) if bits[:, b].any() and not bits[:, b].all()]
        padded = np.zeros((len(self.used), self.words * 64), np.uint8)
        padded[:, : len(fps)] = bits.T[self.used]
        self.planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self.bits = bits[:, self.used].astype(bool)
        tail = np.zeros(self.words * 64, np.uint8)
        tail[: len(fps)] = 1
        self.members = np.packbits(tail, bitorder="little").view(np.uint64)

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """A packed row for each query: the members within radius bits."""
        shape = (len(queries), self.words)
        counters, over = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())], np.zeros(shape, np.uint64)
        over |= ~self.members
        flips = np.where(self.bits[queries], ~np.uint64(0), np.uint64(0))
        for b in range(len(self.used)):
            carry = self.planes[b][None, :] ^ flips[:, b][:, None]
            for counter in counters:
                both = counter & carry
                counter ^= carry
                carry = both
            over |= carry
            if b % 8 == 7 and b + 1 < len(self.used) and not (~self._past(counters, over, radius)).any():
                return np.zeros(shape, np.uint64)
        return ~self._past(counters, over, radius)

    @staticmethod
    def _past(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
        """Where the counters, lowest first, hold more than radius."""
        past, level = over, ~np.uint64(0)
        for k in reversed(range(len(counters))):
            if not radius >> k & 1:
                past = past | level & counters[k]
            level = level & (counters[k] if radius >> k & 1 else ~counters[k])
        return past


def group_links(fps: np.ndarray, radius: int = RADIUS, direct: bool = False) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links within radius do: each
    linked member with the first member of its group, or if direct, with one within radius."""
    if len(fps) == 2:
        return [(int(fps[1]), int(fps[0]))] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    planes, links = BitPlanes(fps), []
    left = planes.members.copy()
    for root in range(len(fps)):
        if not int(left[root >> 6]) >> (root & 63) & 1:
            continue
        left[root >> 6] &= ~np.uint64(1 << (root & 63))
        front = np.array([root])
        while len(front):
            found = []
            for i in range(0, len(front), QUERY_BLOCK):
                rows = planes.within(front[i : i + QUERY_BLOCK], radius)
                near = np.bitwise_or.reduce(rows, axis=0) & left
                if near.any():
                    left &= ~near
                    new = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
                    by = front[i + (rows[:, new >> 6] >> (new & 63).astype(np.uint64) & np.uint64(1)).argmax(axis=0)] if direct else np.full(len(new), root)
                    links += zip(fps[new].tolist(), fps[by].tolist(), strict=True)
                    found.append(new)
            front = np.concatenate(found) if found else np.array([], np.int64)
    return links


def file_links(flat: np.ndarray, offsets: np.ndarray, radius: int = WIDE) -> list[tuple[int, int]]:
    """The direct links of many files, given as one array and its offsets. Most files of a wide radius
    have no link, so members that are near no other are left out before links are followed."""
    sizes, linked = np.diff(offsets), []
    for size in np.unique(sizes).tolist():
        starts = offsets[:-1][sizes == size]
        if size > SMALL:
            for start in starts.tolist():
                fps = np.sort(flat[start : start + size])
                planes = BitPlanes(fps)
                alone = np.concatenate([np.bitwise_count(planes.within(np.arange(i, min(i + QUERY_BLOCK, size)), radius)).sum(axis=1) < 2 for i in range(0, size, QUERY_BLOCK)])
                linked.append(fps[~alone])
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 17) // max(1, len(i)))
        for at in range(0, len(starts), step):
            members = np.sort(flat[starts[at : at + step, None] + np.arange(size)], axis=1)
            near = np.bitwise_count(members[:, i] ^ members[:, j]) <= radius
            for k in np.flatnonzero(near.any(axis=1)):
                linked.append(members[k, np.unique(np.concatenate((i[near[k]], j[near[k]])))])
    return [x for fps in linked if len(fps) > 1 for x in group_links(fps, radius, direct=True)]


def _compare_wide(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            offsets = column.offsets.to_numpy()
            pairs = np.array(file_links(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0], radius), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _compare_files(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            ends = ends - ends[0]
            links = [x for a, b in zip(ends[:-1], ends[1:], strict=True) for x in group_links(np.sort(flat[a:b]), radius)]
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _keys(fp: Column, radius: int) -> Column:
    """A key for each choice of bytes that two linked fingerprints may agree on."""
    masks = [sum(255 << 8 * i for i in kept) for kept in combinations(range(8), 8 - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(k).cast("byte").alias("choice"), fp.bitwiseAND(F.lit(m)).alias("kept")) for k, m in enumerate(signed)])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of the distinct column fp that join what all links within radius join."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    files = (
        distinct.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"))
        .groupBy("key.choice", "key.kept")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )
    return files.mapInArrow(_compare_files(radius), "a long, b long").distinct()


def close_pairs(distinct: DataFrame, radius: int = WIDE) -> DataFrame:
    """Pairs (a, b) of the distinct column fp within radius bits that join what all such pairs join, to be confirmed.

    At 6 bits a file has 16 bits in common, about one in 65,536 of the fingerprints.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    # Hardly any key repeats within a task, so rows go to their file as they are: gathering them first only takes memory.
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key")).select("fp", "key.*").repartition("choice", "kept")
    files = keyed.groupBy("choice", "kept").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return files.mapInArrow(_compare_wide(radius), "a long, b long").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): alternating large-star and small-star.

    Each round is written to the shared folder, so lineage stays short and a lost
    executor costs one round at most; only counts come to the driver.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().write.parquet(path)
    for _ in range(rounds):
        now = spark.read.parquet(path)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, large.a == low.n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = small.select("e.a", "e.b").where("a <> b").distinct()
        old, path = path, scratch(spark, "edges")
        after.write.parquet(path)
        now, after = spark.read.parquet(old), spark.read.parquet(path)
        same = [r.asDict() for r in (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for x in (now, after))]
        drop_scratch(spark, old)
        if same[0] == same[1]:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed) and component_id, the smallest doc_id of the row's group."""
    marked = materialise(fingerprints(docs, text, doc_id), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, radius))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(ids, "root").select(F.col("fp").alias("known"), "component_id")
    return marked.join(by_fp, marked.fp == by_fp.known).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies (by fingerprints, confirmed and completed; see similar): that with the smallest doc_id.

    A null doc_id comes last; of several rows with the kept doc_id, that with
    the smallest row_hash stays, and of exact repeats of that row one.
    """
    path = scratch(docs.sparkSession, "similar-sets")
    similar.shingle_sets(docs).write.option("compression", "zstd").parquet(path)
    sets = docs.sparkSession.read.parquet(path)
    roots = similar.similar_keys(sets, docs, close_pairs, connected_components)
    each = sets.groupBy("key", "doc_id", "row_hash").agg(F.count("*").alias("rows"))
    best = each.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash", "rows")).alias("best"))
    named = best.join(roots, best.key == roots.node, "left").select("best", F.coalesce("root", "key").alias("root"))
    kept = materialise(named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("kept_id"), F.col("best.row_hash").alias("kept_hash"), F.col("best.rows").alias("kept_rows")), "similar-kept")
    drop_scratch(docs.sparkSession, path)
    same = (row_hash(docs) == kept["kept_hash"]) & docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"])
    out = docs.join(kept.where("kept_rows = 1"), same, "left_semi")
    if kept.where("kept_rows > 1").limit(1).count():
        out = out.unionByName(docs.join(kept.where("kept_rows > 1"), same, "left_semi").dropDuplicates())
    return out
