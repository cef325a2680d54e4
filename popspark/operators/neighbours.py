"""Exact k nearest neighbours by pivots and the triangle inequality.

Points belong to the cell of their nearest pivot. With U_a the widest point of cell a,
any point of a is within U_a + |p_a p_b| + |p_b s| of a point s of cell b, so the
(k + 1)-th smallest of these over all cells' innermost points bounds how far the k
nearest of a's points can be (one more, since a point is none of its own neighbours).
A point s of cell b is nobody's neighbour in a unless |p_b s| >= |p_a p_b| - U_a - bound,
and goes only to the cells where that holds. Cells meet in blocks of a bounded number of
points; each block gives the k best of its queries, and these short lists are merged.

Where pivots prune so little that points would go to more cells than all pairs have
blocks, all pairs of blocks meet instead, once for both sides. In a block matrix
products tell which few points can be among a query's nearest; their distances are then
worked out exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popspark.functions.vectors import distance

from . import vector_pairs
from .stages import saved

#: Pivots at most (as many vectors are broadcast, and their squares are pairs of cells), and points of one side of a block, about.
MOST_PIVOTS, BLOCK = 256, 1024
#: Numbers of the widest intermediate array of a task, and the share that rounding may take off a bound.
NUMBERS, ROUNDING = 1 << 21, 1e-9


def pivots(points: DataFrame, count: int) -> DataFrame:
    """pivot, p: the first points in md5 order of their keys."""
    first = points.where("v is not null").orderBy(F.md5(F.col("id").cast("string")), "id").limit(count)
    return first.select(F.col("id").alias("pivot"), F.col("v").alias("p"))


def cells(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, v, cell and near (the distance to the cell's pivot)."""
    # At most MOST_PIVOTS rows a point, aggregated where they arise.
    met = points.crossJoin(F.broadcast(chosen)).select("id", "v", F.struct(distance(F.col("v"), F.col("p")).alias("near"), F.col("pivot").alias("cell")).alias("c"))
    return met.groupBy("id").agg(F.min("c").alias("c"), F.first("v").alias("v")).select("id", "v", "c.cell", "c.near")


def reach(held: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """a, b, least: a point of cell b is a candidate for cell a only if it is at least so far from its pivot."""
    widest = held.groupBy("cell").agg(F.max("near").alias("u"))
    inner = held.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("near", "id"))).where(F.col("r") <= k + 1).select(F.col("cell").alias("b"), "near")
    one, two = (chosen.select(F.col("pivot").alias(x), F.col("p").alias(f"p_{x}")) for x in "ab")
    # One row a pair of cells.
    gaps = one.crossJoin(F.broadcast(two)).select("a", "b", distance(F.col("p_a"), F.col("p_b")).alias("gap"))
    gaps = gaps.join(widest.select(F.col("cell").alias("a"), "u"), "a")
    upper = gaps.join(inner, "b").select("a", (F.col("u") + F.col("gap") + F.col("near")).alias("upper"))
    bound = upper.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("upper"))).where(F.col("r") <= k + 1)
    # With fewer points than neighbours asked for, every cell is a candidate.
    bound = bound.groupBy("a").agg(F.when(F.count("*") > k, F.max("upper")).otherwise(float("inf")).alias("bound"))
    slack = (F.col("gap") + F.col("u") + F.col("bound")) * ROUNDING
    return gaps.join(bound, "a").select("a", "b", (F.col("gap") - F.col("u") - F.col("bound") - slack).alias("least"))


def _distances(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the pairs x[r], y[c]."""
    out = np.empty(len(r))
    step = max(1, NUMBERS // max(1, x.shape[1]))
    for i in range(0, len(r), step):
        out[i : i + step] = np.sqrt(((x[r[i : i + step]] - y[c[i : i + step]]) ** 2).sum(1))
    return out


def _best(x: np.ndarray, y: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and distances of each x's k nearest, ties to the earlier y; own: the y that x itself is, or -1."""
    found = []
    step = max(1, NUMBERS // max(1, len(y)))
    with np.errstate(all="ignore"):
        yy = (y * y).sum(1)
        for i in range(0, len(x), step):
            part = x[i : i + step]
            xx = (part * part).sum(1)
            about = xx[:, None] + yy - 2 * (part @ y.T)
            # Twice what rounding may add to a squared distance, generously.
            slack = 16 * (x.shape[1] + 8) * 2.0**-53 * (xx + yy.max(initial=0.0))
            # Infinite or undefined ones are decided by their distances.
            unsure = ~np.isfinite(about)
            about[unsure] = 0.0
            rows = np.flatnonzero(own[i : i + step] >= 0)
            about[rows, own[i : i + step][rows]] = np.inf
            if unsure.any() or k >= len(y):
                r, c = np.nonzero(np.isfinite(about))
            else:
                r, c = np.nonzero(about <= (np.partition(about, k - 1, axis=1)[:, k - 1] + slack)[:, None])
                some = np.isfinite(about[r, c])
                r, c = r[some], c[some]
            d = _distances(part, y, r, c)
            fine = np.isfinite(d)
            r, c, d = r[fine], c[fine], d[fine]
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
            rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
            first = rank < k
            found.append((r[first] + i, c[first], d[first]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _nearest(k: int):
    def run(key, queries, near):
        ids = lambda t: (lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c)(t.column("id").combine_chunks())
        left, right = ids(queries), ids(near)
        if not len(left) or not len(right):
            return pa.table({"src": left.slice(0, 0), "dst": right.slice(0, 0), "weight": pa.array([], pa.float64())})
        x, y = (np.array(t.column("v").to_pylist(), float) for t in (queries, near))
        # Columns stand in order of their ids.
        order = pa.compute.sort_indices(right).to_numpy()
        y, right = y[order], right.take(pa.array(order))
        same = {v: i for i, v in enumerate(right.to_pylist())}
        r, c, d = _best(x, y, np.array([same.get(v, -1) for v in left.to_pylist()]), k)
        return pa.table({"src": left.take(pa.array(r)), "dst": right.take(pa.array(c)), "weight": pa.array(d)})

    return run


def _all_blocks(points: DataFrame, kind: str, k: int) -> DataFrame:
    """src, dst, weight: the k nearest of each point in every block of points."""

    def run(batches):
        first = None
        for batch in batches:
            for at in range(batch.num_rows):
                ids = batch.column("ids")[at].values
                x = np.frombuffer(batch.column("vectors")[at].as_buffer(), float).reshape(len(ids), -1)
                if batch.column("side")[at].as_py() == 0:
                    first = ids, x
                    continue
                same = batch.column("p")[at].as_py() == batch.column("q")[at].as_py()
                (left, a), (right, b) = first, (ids, x)
                for one, u, two, v in [(left, a, right, b)] + [(right, b, left, a)] * (not same):
                    # Blocks are in order of their ids.
                    r, c, d = _best(u, v, np.arange(len(u)) if same else np.full(len(u), -1), k)
                    yield pa.RecordBatch.from_arrays([one.take(pa.array(r)), two.take(pa.array(c)), pa.array(d)], names=["src", "dst", "weight"])

    return vector_pairs.met(points, "id", "v", []).mapInArrow(run, f"src {kind}, dst {kind}, weight double")


def _sent(points: DataFrame, k: int, most_pivots: int) -> tuple[DataFrame, DataFrame]:
    """The points with their cells, and which of a cell's points which other cell needs."""
    chosen = saved(pivots(points, max(1, min(most_pivots, int(np.sqrt(points.count()))))), "pivots")
    held = saved(cells(points, chosen), "cells")
    return held, saved(reach(held, chosen, k), "reach")


def candidates(points: DataFrame, k: int, most_pivots: int = MOST_PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The queries (id, v, a, left, right) and the points sent to each cell (the same columns), dealt to blocks of a cell."""
    return _dealt(*_sent(saved(points, "points"), k, most_pivots))


def _dealt(held: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    sent = saved(held.select("id", "v", "near", F.col("cell").alias("b")).join(F.broadcast(wanted), "b").where(F.col("near") >= F.col("least")).select("id", "v", "a"), "sent")
    own = held.select("id", "v", F.col("cell").alias("a"))
    sizes = lambda df, name: df.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias(name))
    parts = sizes(own, "lefts").join(sizes(sent, "rights"), "a")
    part = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    queries = own.join(F.broadcast(parts), "a").select("id", "v", "a", part("lefts").alias("left"), every("rights").alias("right"))
    others = sent.join(F.broadcast(parts), "a").select("id", "v", "a", part("rights").alias("right"), every("lefts").alias("left"))
    return queries, others


def nearest(points: DataFrame, key: str, vector: str, k: int, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """src, dst, weight, rank: each point's k nearest others (all, if fewer), ties to the smaller key. Points without a vector take no part."""
    kind = points.schema[key].dataType.simpleString()
    slim = points.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    slim = saved(slim, "points")
    held, wanted = _sent(slim, k, most_pivots)
    n = held.count()
    # As many copies of a point as all pairs of blocks would need.
    copies = max(vector_pairs.BLOCKS, -(-n // vector_pairs.BLOCK))
    sent = held.select("near", F.col("cell").alias("b")).join(F.broadcast(wanted), "b").where(F.col("near") >= F.col("least")).count()
    if sent > n * copies and held.agg(F.count_distinct(F.size("v"))).first()[0] == 1:
        found = _all_blocks(slim, kind, k)
    else:
        queries, others = _dealt(held, wanted)
        keys = ("a", "left", "right")
        found = queries.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(_nearest(k), f"src {kind}, dst {kind}, weight double")
    # k rows a block that a query has met, not a row a point.
    rank = F.row_number().over(Window.partitionBy("src").orderBy("weight", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pairs_compared(points: DataFrame, key: str, vector: str, k: int, most_pivots: int = MOST_PIVOTS) -> int:
    """How many pairs of points the blocks of `nearest` hold."""
    queries, others = candidates(points.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"), k, most_pivots)
    a, b = (t.groupBy("a", "left", "right").agg(F.count("*").alias(n)) for t, n in ((queries, "x"), (others, "y")))
    return a.join(b, ["a", "left", "right"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]
