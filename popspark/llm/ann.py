"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks; each pair of blocks is a tile. In a
tile every vector is scaled to int8. The product of the two int8 matrices (held
as float32, whose sums of int8 products are exact up to 1,040 dimensions; float64
beyond) times the scales gives approximate inner products. The residues'
norms bound each one's error: |x.y - x'.y'| <= |x'||ry| + |rx||y'| + |rx||ry|. A
pair survives if its upper bound reaches the query's k-th largest lower bound so
far. Survivors are recomputed from the original vectors in double precision, in
index order, and each query keeps its k best in a heap across the sub-tiles. The
heaps of all tiles are merged by a ranking of k rows a tile and query. The result
is exact.

Data moved: each candidate once for each query block, each query once for each
candidate block; block sizes grow with the input between fixed bounds.

Nulls and edge cases: rows with a null vec_id, a null or zero vector, or a
vector with null or non-finite components take no part; vectors are compared
only with vectors of the same length; rows that repeat a vec_id are rows of their own, as
queries and as candidates; a sum that overflows counts as the infinity it ends at,
and one in which both infinities meet as minus infinity; equal scores go to the smaller vec_id; fewer than k
candidates are all returned; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

NEIGHBOURS, QUERY_EVERY = 20, 20
#: Rows of a query block and of a candidate block, least and most; rows of a sub-tile.
QUERY_BLOCK, CANDIDATE_BLOCK, SUB_TILE = (1024, 8192), (8192, 16384), (256, 4096)
SLACK = 1e-9


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, row (a number among the rows of one vec_id), vec (double) and dim of the rows that take part."""
    v = F.col("vec")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    fine = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    row = F.row_number().over(Window.partitionBy("vec_id").orderBy("vec"))
    return rows.where(fine).select("vec_id", row.alias("row"), "vec", F.size("vec").alias("dim"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values as floats, scales, norms of the scaled-back vectors, norms of the residues."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(float).tiny
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    # In units of the scale, whose square can overflow; the residue is worked out before, as it may be as small.
    return q.astype(kind), scale, np.linalg.norm(q, axis=1) * scale, np.linalg.norm((x - back) / scale[:, None], axis=1) * scale


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in index order."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return np.where(np.isnan(out), -np.inf, out)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, query_rows: np.ndarray | None = None, rows: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """(query_id, vec_id, score, query_row) of each query's k best in this tile, itself (equal id and row) left out."""
    query_rows = np.zeros(len(query_ids), np.int64) if query_rows is None else query_rows
    rows = np.zeros(len(ids), np.int64) if rows is None else rows
    with np.errstate(over="ignore", invalid="ignore"):
        return _tile(query_ids, queries, ids, vectors, k, query_rows, rows)


def _tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, query_rows: np.ndarray, row_of: np.ndarray) -> list[tuple[int, int, float, int]]:
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    qq, qs, qn, qr = quantise(queries)
    cq, cs, cn, cr = quantise(vectors)
    for a in range(0, len(ids), SUB_TILE[1]):
        part = slice(a, a + SUB_TILE[1])
        for b in range(0, len(query_ids), SUB_TILE[0]):
            rows = slice(b, b + SUB_TILE[0])
            near = (qq[rows] @ cq[part].T).astype(np.float64) * qs[rows, None] * cs[None, part]
            bound = qn[rows, None] * cr[None, part] + qr[rows, None] * (cn[part] + cr[part])[None, :]
            bound += SLACK * (qn[rows] + qr[rows])[:, None] * (cn[part] + cr[part])[None, :]
            own = (query_ids[rows, None] == ids[None, part]) & (query_rows[rows, None] == row_of[None, part])
            # Where sums overflow nothing is known: such a pair is kept and raises no floor.
            low, high = near - bound, near + bound
            low[own | np.isnan(low)] = -np.inf
            high[np.isnan(high)] = np.inf
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
            held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[rows]])
            keep = (high >= np.maximum(floor, held)[:, None]) & ~own
            i, j = np.nonzero(keep)
            for at in range(0, len(i), 1 << 17):
                ii, jj = i[at : at + (1 << 17)] + b, j[at : at + (1 << 17)] + a
                for q, v, s in zip(ii.tolist(), ids[jj].tolist(), exact_products(queries[ii], vectors[jj]).tolist(), strict=True):
                    heap = heaps[q]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    elif (s, -v) > heap[0]:
                        heapq.heapreplace(heap, (s, -v))
    return [(int(q), -v, s, int(r)) for q, r, heap in zip(query_ids, query_rows, heaps, strict=True) for s, v in heap]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = table.column("vec").combine_chunks()
    ids = table.column("vec_id").to_numpy()
    return ids, column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), table.column("row").to_numpy()


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score, query_row for each query: the rows whose vec_id is divisible by `every`.

    `vectors` is what valid_vectors returns.
    """
    vectors = materialise(vectors, "vectors")
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("q")).first()
    q_rows = min(max(sizes.q // 8, QUERY_BLOCK[0]), QUERY_BLOCK[1])
    c_rows = min(max(sizes.n // 64, CANDIDATE_BLOCK[0]), CANDIDATE_BLOCK[1])
    q_blocks, c_blocks = max(1, -(-sizes.q // q_rows)), max(1, -(-sizes.n // c_rows))
    spread = F.xxhash64("vec_id")
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("q_block", F.pmod(spread, F.lit(q_blocks)))
    queries = queries.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)).cast("array<bigint>")))
    candidates = vectors.withColumn("c_block", F.pmod(spread, F.lit(c_blocks)))
    candidates = candidates.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (query_ids, queries, query_rows), (ids, vectors, rows) = _matrix(left), _matrix(right)
            found = tile(query_ids, queries, ids, vectors, k, query_rows, rows)
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64(), "query_row": pa.int32()}
        return pa.table({name: pa.array([x[i] for x in found], kind) for i, (name, kind) in enumerate(kinds.items())})

    keys = ["dim", "q_block", "c_block"]
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double, query_row int")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")
