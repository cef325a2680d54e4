"""Matrices as long tables (i, j, value) and triangles (i < j, value).

Covers A22-A25, U1-U4, M26-M54, P11-P18, S18, K5, K9-K12. Cells that are absent
read as NaN from a full matrix and as 0 from a triangle. Element-wise operations
and sums are joins and aggregations on the indices, so a matrix may be of any
size; factorisations reduce the rows to a p x p triangle by a tree of QR steps and
factor that on the driver, which needs p (columns), not n (rows), to be small.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.functions.vectors import divide, nan

from . import vector_pairs
from .stages import numbered, saved

MOST_COLUMNS = 4096  # a p x p table that the driver may factor: 128 MB
MOST_BROADCAST = 1_000_000  # rows of an index that goes to every task
PART_ROWS = 1024  # rows of a stratum that meet all others of it in one task
FAN = 4  # triangles of a step of the reduction


def from_nested(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """Row-major nested lists."""
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], "i int, j int, value double")


def from_vector(df: DataFrame, order: str, value: str, columns: int) -> DataFrame:
    """The values in order as a long matrix of so many columns, row by row."""
    place = numbered(df.select(order, F.col(value).cast("double").alias("value")), [order], "place")
    return place.select(F.floor(F.col("place") / columns).cast("int").alias("i"), (F.col("place") % columns).cast("int").alias("j"), "value")


def from_arrays(df: DataFrame, row: str, values: str) -> DataFrame:
    """A row index and an array column as a long matrix."""
    return df.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "value"))


def to_arrays(m: DataFrame) -> DataFrame:
    """i and its values in order of j (K11); a row is one array, so columns are bounded by memory."""
    return m.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: s["value"]).alias("row"))


def filled(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    """A constant matrix."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / max(cols, 1)).cast("int").alias("i"), (F.col("id") % max(cols, 1)).cast("int").alias("j"), F.lit(float(value)).alias("value"))


def linspace(spark: SparkSession, low: float, high: float, rows: int, cols: int) -> DataFrame:
    """Evenly spaced values from low to high, the last exactly high."""
    n = rows * cols
    step = (high - low) / (n - 1) if n > 1 else 0.0
    at = F.col("i") * cols + F.col("j")
    return filled(spark, rows, cols).withColumn("value", F.when(at == n - 1, F.lit(float(high)) if n > 1 else F.lit(float(low))).otherwise(F.lit(float(low)) + at * step))


def transpose(m: DataFrame) -> DataFrame:
    """Rows and columns swapped."""
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def row_sums(m: DataFrame) -> DataFrame:
    """A22."""
    return m.groupBy("i").agg(F.sum("value").alias("total"))


def col_sums(m: DataFrame) -> DataFrame:
    """A23."""
    return m.groupBy("j").agg(F.sum("value").alias("total"))


def total(m: DataFrame) -> DataFrame:
    """A24."""
    return m.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def trace(m: DataFrame) -> DataFrame:
    """A25."""
    return m.where("i = j").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("trace"))


def diagonal(m: DataFrame) -> DataFrame:
    """M30."""
    return m.where("i = j").select("i", "value")


def set_diagonal(m: DataFrame, values: DataFrame) -> DataFrame:
    """m with values (i, value) on its diagonal."""
    return m.where("i <> j").unionByName(values.select("i", F.col("i").alias("j"), "value"))


def diagonal_matrix(values: DataFrame) -> DataFrame:
    """values (i, value) on the diagonal, zeros elsewhere."""
    other = values.select(F.col("i").alias("j"))
    return values.crossJoin(other).select("i", "j", F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(0.0).alias("value"))


def scalar(m: DataFrame, op: str, s: float) -> DataFrame:
    """m op s (M45-M48)."""
    v, c = F.col("value"), F.lit(float(s))
    return m.withColumn("value", {"+": v + c, "-": v - c, "*": v * c, "/": divide(v, c)}[op])


def elementwise(a: DataFrame, op: str, b: DataFrame) -> DataFrame:
    """a op b cell by cell (M39-M42); empty if the shapes differ."""
    both = a.join(b.select("i", "j", F.col("value").alias("other")), ["i", "j"])
    shape = lambda m: m.agg(F.max("i").alias("r"), F.max("j").alias("c"))
    same = shape(a).join(shape(b), ["r", "c"]).select(F.lit(1).alias("same"))  # one row or none
    x, y = F.col("value"), F.col("other")
    out = {"+": x + y, "-": x - y, "*": x * y, "/": divide(x, y)}[op]
    return both.crossJoin(F.broadcast(same)).select("i", "j", out.alias("value"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product (M43), by a join on the inner index and partial sums."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("value").alias("other"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("value") * F.col("other")).alias("value"))


def multiply_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """Square matrix times vector (i, value)."""
    right = v.select(F.col("i").alias("k"), F.col("value").alias("other"))
    return a.join(right, a["j"] == right["k"]).groupBy("i").agg(F.sum(F.col("value") * F.col("other")).alias("value"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether the cells agree."""
    left, right = a.select("i", "j", "value"), b.select("i", "j", "value")
    differ = left.exceptAll(right).unionByName(right.exceptAll(left))
    return differ.agg((F.count("*") == 0).alias("equal"))


def row_matrix(m: DataFrame) -> DataFrame:
    """Every cell its row's sum."""
    return m.drop("value").join(row_sums(m), "i").select("i", "j", F.col("total").alias("value"))


def gower_centered(d: DataFrame) -> DataFrame:
    """Covariance from squared distances, (-D + (R + R') / K - S / K^2) / 2."""
    rows = row_sums(d).select(F.col("i").alias("ri"), F.col("total").alias("row_total"))
    cols = row_sums(d).select(F.col("i").alias("rj"), F.col("total").alias("col_total"))
    whole = d.agg(F.sum("value").alias("grand"), F.count_distinct("i").cast("double").alias("k"))
    out = d.join(rows, d["i"] == rows["ri"]).join(cols, d["j"] == cols["rj"]).crossJoin(F.broadcast(whole))
    return out.select("i", "j", (0.5 * (-F.col("value") + (F.col("row_total") + F.col("col_total")) / F.col("k") - F.col("grand") / (F.col("k") * F.col("k")))).alias("value"))


def distance_from_covariance(c: DataFrame) -> DataFrame:
    """c_ii + c_jj - 2 c_ij."""
    a = diagonal(c).select(F.col("i").alias("di"), F.col("value").alias("vi"))
    b = diagonal(c).select(F.col("i").alias("dj"), F.col("value").alias("vj"))
    return c.join(a, c["i"] == a["di"]).join(b, c["j"] == b["dj"]).select("i", "j", (F.col("vi") + F.col("vj") - 2 * F.col("value")).alias("value"))


def centered(m: DataFrame) -> DataFrame:
    """Columns minus their means."""
    means = m.groupBy(F.col("j").alias("mj")).agg(F.avg("value").alias("mean"))
    return m.join(means, m["j"] == means["mj"]).select("i", "j", (F.col("value") - F.col("mean")).alias("value"))


def row_distances(rows: DataFrame, key: str, vector: str, upper: bool = False, digits: int | None = None) -> DataFrame:
    """Euclidean distances of all rows from all rows, or with `upper` of i < j, (i, j, value) (M35), rounded to `digits`. Quadratic by its nature; rows are arrays."""
    return vector_pairs.pairs(rows, key, vector, ["value"], lambda x, y, *_: [_rounded(vector_pairs.distances(x, y), digits)], upper)


def _rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    return values if digits is None else vector_pairs.half_up(values, digits)


def gower_of_rows(rows: DataFrame, key: str, vector: str, digits: int | None = None, out_digits: int | None = None) -> DataFrame:
    """`gower_centered` of `row_distances` (rounded to `digits`), in two passes over blocks of pairs: row sums, then cells."""
    far = lambda x, y, *_: [_rounded(vector_pairs.distances(x, y), digits)]
    sums = saved(vector_pairs.row_totals(rows, key, vector, far), "row-sums")
    grand, k = sums.agg(F.sum("total"), F.count("*")).first()
    held = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).join(sums.withColumnRenamed("i", "id"), "id")

    def cells(x, y, own_x, own_y):
        return [_rounded(0.5 * (-far(x, y)[0] + (own_x + own_y[:, 0]) / k - grand / (k * k)), out_digits)]

    return vector_pairs.pairs(held, "id", "v", ["value"], cells, own=["total"])


def distances_of_products(rows: DataFrame, key: str, vector: str, digits: int | None = None) -> DataFrame:
    """`distance_from_covariance` of the inner products of all rows with all rows, by blocks of pairs."""

    def norms(z: np.ndarray) -> np.ndarray:
        out = np.zeros(len(z))
        for k in range(z.shape[1]):
            out += z[:, k] * z[:, k]
        return out

    return vector_pairs.pairs(rows, key, vector, ["value"], lambda x, y, *_: [_rounded(norms(x)[:, None] + norms(y) - 2 * vector_pairs.products(x, y), digits)])


def design_matrix(strata: DataFrame, row: str, stratum: str) -> DataFrame:
    """One-hot columns of the sorted strata: (i, j, stratum, value)."""
    names = strata.select(stratum).distinct()
    ranked = names.select(F.col(stratum).alias("name")).join(names.select(F.col(stratum).alias("lower")), F.col("lower") < F.col("name"), "left")
    codes = ranked.groupBy("name").agg(F.count("lower").cast("int").alias("j"))
    return strata.select(F.col(row).alias("i"), F.col(stratum).alias("own")).crossJoin(F.broadcast(codes)).select("i", "j", F.col("name").alias("stratum"), F.when(F.col("own") == F.col("name"), 1.0).otherwise(0.0).alias("value"))


def hat_matrix(strata: DataFrame, row: str, stratum: str, digits: int | None = None) -> DataFrame:
    """The projector on the strata's means, 1 / n_g for two rows of one stratum (M37), rounded to `digits`; cells across strata are 0 and left out.

    A stratum's rows are dealt to parts of about PART_ROWS that meet all of its rows, so
    that a large stratum is not one task.
    """
    a = strata.select(F.col(row).alias("i"), F.col(stratum).alias("g"))
    value = 1.0 / F.count("*")
    n = a.groupBy("g").agg((value if digits is None else F.round(value, digits) + F.lit(0.0)).alias("value"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    held = a.join(n, "g")
    left = held.select("i", "g", "value", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int").alias("part"))
    right = held.select(F.col("i").alias("j"), "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["g", "part"]).select("i", "j", "value")


def gather(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells at the index lists rows (at, i) and cols (at, j), in their places; NaN outside."""
    r = rows.select(F.col("at").alias("ri"), F.col("i"))
    c = cols.select(F.col("at").alias("cj"), F.col("j"))
    return r.crossJoin(c).join(m, ["i", "j"], "left").select(F.col("ri").alias("i"), F.col("cj").alias("j"), F.coalesce("value", nan()).alias("value"))


def row(m: DataFrame, r: int) -> DataFrame:
    """P14."""
    return m.where(F.col("i") == r).select("j", "value")


def col(m: DataFrame, c: int) -> DataFrame:
    """P15."""
    return m.where(F.col("j") == c).select("i", "value")


def triangle_gather(t: DataFrame, index: DataFrame) -> DataFrame:
    """The triangle among the rows of index (at, i)."""
    a, b = index.select(F.col("at").alias("pa"), F.col("i").alias("a")), index.select(F.col("at").alias("pb"), F.col("i").alias("b"))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    cells = t.select(low.alias("a"), high.alias("b"), "value")
    if index.count() <= MOST_BROADCAST:
        a, b = F.broadcast(a), F.broadcast(b)
    # Each cell stands under the two places of its ends, the smaller first.
    both = cells.join(a, "a").join(b, "b").where("pa <> pb")
    return both.select(F.least("pa", "pb").alias("i"), F.greatest("pa", "pb").alias("j"), "value")


def dense(t: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The triangle mirrored, with a zero diagonal."""
    nodes = t.select("i").union(t.select("j")).distinct() if nodes is None else nodes.select("i")
    both = F.inline(F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value")))
    return t.select(both).unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(0.0).alias("value")))


def add_triangles(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Cell sums (or differences) of two triangles."""
    parts = a.select("i", "j", "value").unionByName(b.select("i", "j", (F.col("value") * sign).alias("value")))
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def added(first: Column, second: Column, sign: int = 1) -> Column:
    """`add_triangles` for two triangles that stand side by side in a row: a cell that is null in one of them is 0 there."""
    return F.coalesce(first, F.lit(0.0)) + F.coalesce(second, F.lit(0.0)) * sign


def named_cell(m: DataFrame, a: str, b: str) -> DataFrame:
    """The cell of two group names in either order; no row if unknown."""
    return m.where(((F.col("GroupA") == a) & (F.col("GroupB") == b)) | ((F.col("GroupA") == b) & (F.col("GroupB") == a)))


def means(rows: DataFrame, vector: str) -> tuple[np.ndarray, int]:
    """Column means of the rows' vectors and their number; rows without a vector do not count."""

    def partial(batches):
        sums, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                sums = x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()])], names=["n", "sums"])

    parts = _vectors(rows, vector).mapInArrow(partial, "n long, sums array<double>")
    # Summed position by position, so the driver gets one row of sums however many tasks there were.
    at = parts.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").limit(MOST_COLUMNS + 1).toArrow()
    if at.num_rows > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    n = at.column("n")[0].as_py() if at.num_rows else 0
    return at.column("x").to_numpy() / max(n, 1), n


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    return rows.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())


def triangular_factor(rows: DataFrame, vector: str, center: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """R of X = QR for the rows' vectors (less their means if centred), the means, and the number of rows.

    Each task reduces its rows to one triangle by Householder reflections; triangles
    are stacked and reduced FAN at a time until one is left. X'X, which would square
    the condition number, is never formed.
    """
    mean, n = means(rows, vector)
    p = len(mean)
    shift = mean if center else np.zeros(p)

    def reduce_rows(batches):
        held = np.zeros((0, p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - shift
            # In pieces about as long as they are wide: the stack stays small.
            for k in range(0, len(x), max(p, 256)):
                held = np.linalg.qr(np.vstack([held, x[k : k + max(p, 256)]]), mode="r")
        if held.size:
            yield triangle(TaskContext.get().partitionId(), held)

    def triangle(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    def merge(key, t):
        stack = np.vstack([r.values.to_numpy().reshape(-1, p) for r in t.column("r")])
        return pa.Table.from_batches([triangle(key[0].as_py(), np.linalg.qr(stack, mode="r"))])

    schema = "part int, r array<double>"
    held = saved(_vectors(rows, vector).mapInArrow(reduce_rows, schema), "triangles")
    while held.count() > 1:
        held = saved(held.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("next")).applyInArrow(merge, schema), "triangles")
    last = held.first()
    return (np.array(last.r).reshape(-1, p) if last is not None else np.zeros((0, p))), mean, n


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry in size is positive."""
    at = np.abs(v).argmax(axis=0)
    return v * np.where(v[at, range(v.shape[1])] < 0, -1.0, 1.0)


def singular_values(rows: DataFrame, vector: str, center: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """d and V of X = U d V' from the triangular factor, columns by falling d; the means; n."""
    r, mean, n = triangular_factor(rows, vector, center)
    if not r.size:
        return np.zeros(0), np.zeros((len(mean), 0)), mean, n
    d, v = np.linalg.svd(r)[1:]
    return d[: min(n, len(mean))], _signed(v.T[:, : min(n, len(mean))]), mean, n


def principal_components(rows: DataFrame, key: str, vector: str, k: int = 2, center: bool = True) -> DataFrame:
    """key and the scores on k components (M53; with center=False the scores use the raw rows, M52)."""
    _, v, mean, _ = singular_values(rows, vector, center=True)
    shift = mean @ v if center else np.zeros(v.shape[1])
    scores = [F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in v[:, c]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - F.lit(float(shift[c])) for c in range(min(k, v.shape[1]))]
    return rows.select(F.col(key), *[s.alias(f"pc{c + 1}") for c, s in enumerate(scores)])


def component_sds(rows: DataFrame, vector: str) -> list[float]:
    """d / sqrt(max(1, n - 1)) of the centred rows."""
    d, _, _, n = singular_values(rows, vector, center=True)
    return (d / np.sqrt(max(1, n - 1))).tolist()


def generalized_inverse(a: np.ndarray) -> np.ndarray:
    """The LU inverse; 0 x 0 if singular or not square."""
    a = np.asarray(a, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1] or not a.size:
        return np.zeros((0, 0))
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.zeros((0, 0))


def dominant_eigenvector(m: DataFrame, tolerance: float = 1e-9, most: int = 1000, seed: int = 1) -> list[float] | None:
    """Power iteration from a random start over a p x p table; null if it doesn't settle."""
    last = m.agg(F.max("i").alias("last")).first().last
    p = 0 if last is None else last + 1
    if p > MOST_COLUMNS:
        raise ValueError(f"{p} columns; at most {MOST_COLUMNS} can be iterated on the driver")
    cells = m.toArrow()
    a = np.zeros((p, p))
    a[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("value").to_numpy()
    x = np.random.default_rng(seed).random(p)
    for _ in range(most):
        y = a @ x
        norm = np.linalg.norm(y)
        if not norm:
            return None
        y /= norm
        if np.abs(y - x).max() < tolerance:
            return y.tolist()
        x = y
    return None


def r_matrix(rows: list[list[float]], row_names: list[str] | None = None, col_names: list[str] | None = None) -> str:
    """R source: a tibble with column names, else matrix() (K5)."""
    number = lambda x: repr(float(x))
    if col_names and any(col_names):
        columns = [f"{n} = c({', '.join(number(r[j]) for r in rows)})" for j, n in enumerate(col_names)]
        keys = [f"Key = c({', '.join(json.dumps(n) for n in row_names)})"] if row_names and any(row_names) else []
        return f"tibble({', '.join(keys + columns)})"
    cells = ", ".join(number(x) for r in rows for x in r)
    return f"matrix( c({cells}), ncol={len(rows[0]) if rows else 0}, nrow={len(rows)}, byrow=TRUE)"


def r_source(m: DataFrame) -> DataFrame:
    """r: one row with a long matrix as R source, matrix() by rows; as long as the matrix (K5)."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "value")))
    text = F.array_join(F.transform(cells, lambda c: c["value"].cast("string")), ", ")
    one = m.agg(text.alias("cells"), F.count_distinct("j").alias("columns"), F.count_distinct("i").alias("rows"))
    return one.select(F.concat(F.lit("matrix( c("), "cells", F.lit("), ncol="), F.col("columns").cast("string"), F.lit(", nrow="), F.col("rows").cast("string"), F.lit(", byrow=TRUE)")).alias("r"))


def to_json(m: DataFrame) -> DataFrame:
    """One JSON document of values, rowNames and colNames (K9)."""
    rows = to_arrays(m).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda s: s["row"]).alias("values"))
    names = m.agg(F.transform(F.array_sort(F.collect_set("i")), lambda i: i.cast("string")).alias("rowNames"), F.transform(F.array_sort(F.collect_set("j")), lambda j: j.cast("string")).alias("colNames"))
    return rows.crossJoin(names).select(F.to_json(F.struct("values", "rowNames", "colNames")).alias("json"))


def from_json(df: DataFrame, json_column: str = "json") -> DataFrame:
    """The inverse of to_json, as a long matrix."""
    parsed = F.from_json(json_column, "values array<array<double>>, rowNames array<string>, colNames array<string>")
    rows = df.select(parsed.alias("m")).select(F.posexplode("m.values").alias("i", "row"))
    return rows.select("i", F.posexplode("row").alias("j", "value"))


def as_matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Numeric columns as a long matrix, missing cells 0."""
    values: list[Column] = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return df.select(F.col(key).alias("i"), F.posexplode(F.array(*values)).alias("j", "value"))
