"""Permutation and subsampling engines and their null distributions.

Covers R2-R4, R8-R20, R26-R28, W1, E4, E40. Samples are drawn in md5 order, so any
SQL engine draws the same ones.

A subsample is what lies under an iteration's threshold: the k-th smallest draw. Of n
draws that are as good as uniform, it lies within a few standard deviations of k / n.
So one pass over the population counts, for all iterations at once, the rows that are
surely drawn (in arrays with a cell an iteration), and hands on the few whose draws lie
in that bracket. Only these are ranked. Counts prove the bracket right; an iteration
where it missed is done again with a wider one, so results are exact. Nothing sorts or
multiplies the population.

A shuffle needs every rank. Draws are dealt to bins of about BIN_ROWS by their first
digits; a rank is the sum of the bins before and a place in the bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popspark.functions.vectors import divide, nan

from .stages import numbered, saved

try:
    from _md5 import md5  # the interpreter's own is quicker for short keys
except ImportError:
    from hashlib import md5

DIRECTIONS = ("greater", "less", "two-sided")
#: An engine's population goes to every task: this many numbers (256 MB) at most.
MOST_POPULATION = 32_000_000
#: Standard deviations on either side of k / n that a threshold is looked for in at first.
SPREAD = 6.0
#: A draw as a number has so many bits of the md5's first; thresholds are compared on them.
DRAW_BITS = 60
#: Rows of a bin of draws that one task ranks, about.
BIN_ROWS = 4096
#: Units whose draws are worked out at a time, rows counted at a time, and arrays that a task gathers before it hands them on.
BLOCK_UNITS, BLOCK_ROWS, MOST_ARRAYS = 128, 2048, 20_000
#: Draws of a task, about, and tasks at most.
TASK_DRAWS, MOST_TASKS = 50_000_000, 20_000


def p_value(values: DataFrame, observed: Column | float, value: str = "value", direction: str = "greater") -> DataFrame:
    """One row: (values at least as extreme + 1) / (values + 1); NaN without values."""
    obs = observed if isinstance(observed, Column) else F.lit(float(observed))
    v = F.col(value)
    up, down = F.count_if(~F.isnan(v) & (v >= obs)), F.count_if(~F.isnan(v) & (v <= obs))
    tail = lambda k: divide(k + 1, F.count(v) + 1)
    p = {"greater": tail(up), "less": tail(down), "two-sided": F.least(F.lit(1.0), 2 * F.least(tail(up), tail(down)))}[direction]
    return values.agg(F.when(F.count(v) > 0, p).otherwise(nan()).alias("p_value"))


def p_value_of(values: np.ndarray, observed: float, direction: str = "greater") -> float:
    """The same from an array."""
    values = np.asarray(values, float)
    if not len(values):
        return float("nan")
    up, down = ((values >= observed).sum() + 1) / (len(values) + 1), ((values <= observed).sum() + 1) / (len(values) + 1)
    return float({"greater": up, "less": down, "two-sided": min(1.0, 2 * min(up, down))}[direction])


def running_p_value(values: DataFrame, observed: float) -> DataFrame:
    """iter, value and the p-value so far (R9, R10). One row an iteration, so one ordered task is enough."""
    past = Window.partitionBy(F.lit(0)).orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    exceed = F.sum(F.when(~F.isnan("value") & (F.col("value") >= observed), 1).otherwise(0)).over(past)
    return values.withColumn("p_value", (exceed + 1) / (F.count("*").over(past) + 1))


def _order(seed: str, unit: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("iter").cast("string"), F.col(unit).cast("string")))


def _brackets(population: DataFrame, by: tuple[str, ...], size: int, spread: float) -> DataFrame:
    """A row for each group: _want (rows to draw), _low and _high, between which its thresholds lie, as draws of DRAW_BITS bits."""
    n, k, whole = F.col("_n"), F.col("_want"), 2.0**DRAW_BITS
    slack = spread * F.sqrt(k.cast("double")) + spread
    bound = lambda x: F.when(k < n, F.floor(F.least(F.greatest(x / n, F.lit(0.0)), F.lit(1.0)) * whole).cast("long")).otherwise(F.lit(1 << DRAW_BITS))
    groups = population.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_want", F.least(F.lit(size).cast("long"), F.col("_n")))
    return saved(groups.withColumns({"_low": bound(k - slack), "_high": bound(k + slack)}).drop("_n"), "brackets")


def _sized(population: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """population with its group's columns; without groups there is one row of them."""
    return _beside(population, groups, list(by), "inner") if by else population.crossJoin(F.broadcast(groups))


def subsamples(population: DataFrame, unit: str, size: int, iterations: int, seed: str, by: tuple[str, ...] = ()) -> DataFrame:
    """iter and the rows of each subsample without replacement: the first `size` in the iteration's md5 order, within each group of the columns `by`.

    All rows of a smaller group. Only rows under the bracket's upper end are kept and ranked.
    """
    spread = SPREAD
    while True:
        rows = _sized(population, _brackets(population, by, size, spread), by).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        drawn = F.conv(F.substring("_draw", 1, DRAW_BITS // 4), 16, 10).cast("long")
        near = saved(rows.withColumn("_draw", _order(seed, unit)).where(drawn < F.col("_high")).drop("_low", "_high"), "near-draws")
        short = near.groupBy(*by, "iter").agg(F.count("*").alias("n"), F.first("_want").alias("want"))
        # A group and iteration without any row is short too.
        found = short.agg(F.count("*").alias("groups"), F.count_if(F.col("n") < F.col("want")).alias("short")).first()
        groups = population.select(*by).distinct().count() if by else population.limit(1).count()
        if found.short == 0 and found.groups == groups * iterations:
            break
        spread *= 4
    rank = F.row_number().over(Window.partitionBy(*by, "iter").orderBy("_draw", unit))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank", "_draw", "_want")


#: Rotations of a step of md5, and its constants.
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Draws that go through md5 at a time: a compromise of calls and cache.
CACHED = 1 << 17


def _first_word(iters: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of one-block messages [unit, iteration], whose bytes are those of an iteration's row or a unit's row of 64 (0 in the other)."""
    one, two = iters.view("<u4").astype(np.uint32), units.view("<u4").astype(np.uint32)
    out = np.empty((len(two), len(one)), np.uint32)
    step = max(1, CACHED // max(1, len(one)))
    for at in range(0, len(two), step):
        mine = two[at : at + step]
        shape = (len(mine), len(one))
        a, b, c, d = (np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        # The first word is settled three steps before the end.
        for i in range(61):
            kind, turn = divmod(i, 16)[0], TURNS[i // 16][i % 4]
            g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
            if kind == 0:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif kind == 1:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif kind == 2:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            word = one[:, g]
            f += np.uint32((int(word[0]) + SINES[i]) & 0xFFFFFFFF) if (word == word[0]).all() else word + np.uint32(SINES[i])
            if mine[:, g].any():
                f += mine[:, g, None]
            np.left_shift(f, np.uint32(turn), out=t)
            np.right_shift(f, np.uint32(32 - turn), out=f)
            f |= t
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        out[at : at + step] = b + np.uint32(0x67452301)
    return out.byteswap()


def _leading(units: list[bytes | None], seed: str, iterations: int) -> np.ndarray:
    """The first 32 bits of the draw of every unit and iteration [unit, iteration]; 0 where a message is longer than md5's block, or there is no unit."""
    out = np.zeros((len(units), iterations), np.uint32)
    lengths = np.array([-1 if u is None else len(u) for u in units])
    start = f"{seed}|".encode()
    first = 0
    while first < iterations:
        digits = len(str(first))
        last = min(iterations, 10**digits)
        head = len(start) + digits + 1
        for n in np.unique(lengths[(lengths >= 0) & (head + lengths <= 55)]).tolist():
            rows = np.flatnonzero(lengths == n)
            one, two = np.zeros((last - first, 64), np.uint8), np.zeros((len(rows), 64), np.uint8)
            one[:, :head] = np.frombuffer(b"".join(start + b"%d|" % i for i in range(first, last)), np.uint8).reshape(-1, head)
            one[:, head + n] = 128
            one[:, 56:58] = divmod(8 * (head + n), 256)[::-1]
            two[:, head : head + n] = np.frombuffer(b"".join(units[r] for r in rows.tolist()), np.uint8).reshape(len(rows), n)
            out[rows, first:last] = _first_word(one, two)
        first = last
    return out


def shuffled_order(units: list[bytes], seed: str, iteration: int) -> np.ndarray:
    """The places of units (of one population, in their order) by the md5 of an iteration, as `relabelled` ranks them."""
    start = f"{seed}|{iteration}|".encode()
    digests = np.frombuffer(b"".join([md5(start + u).digest() for u in units]), ">u8").reshape(len(units), 2)
    high = digests[:, 0].astype(np.uint64)
    order = np.argsort(high, kind="stable")
    # Equal in their first half: by the whole, and at last by their order.
    if (high[order][1:] == high[order][:-1]).any():
        order = np.lexsort((digests[:, 1].astype(np.uint64), high))
    return order


def _codes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """A number for each row, equal for rows that agree in all columns."""
    code = np.zeros(table.num_rows, np.int64)
    for c in columns:
        d = table.column(c).combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        own = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(d.dictionary) + 1) + own, return_inverse=True)[1]
    return code


def _count_draws(rows: DataFrame, seed: str, iterations: int, by: list[str], of: list[str]) -> DataFrame:
    """by, of, counts (of the surely drawn, an element an iteration); or by, of, _unit, iter and _draw of a row within the bracket."""
    keys = [*by, *of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: dict[str, pa.DataType] = {}
        heads = [f"{seed}|{i}|".encode() for i in range(iterations)]
        known: tuple[list, np.ndarray] = ([], np.zeros((0, iterations), np.uint32))

        def counted() -> Iterator[pa.RecordBatch]:
            items = list(sums.items())
            sums.clear()
            for i in range(0, len(items), 500):
                some = items[i : i + 500]
                cells = [pa.array([k[j] for k, _ in some], kinds[c]) for j, c in enumerate(keys)]
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * iterations, pa.int32()), pa.array(np.concatenate([a for _, a in some])))
                empty = [pa.nulls(len(some), k) for k in (pa.string(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([*cells, arrays, *empty], names=[*keys, "counts", "_unit", "iter", "_draw"])

        for batch in batches:
            kinds.update({c: batch.schema.field(c).type for c in keys})
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = pa.Table.from_batches([batch.slice(start, BLOCK_ROWS)])
                names = part.column("_unit").to_pylist()
                low, high = (part.column(c).to_numpy() for c in ("_low", "_high"))
                code = _codes(part, keys)
                ends = np.append(np.flatnonzero([a != b for a, b in zip(names[1:], names[:-1], strict=True)]) + 1, len(names))
                firsts = np.append(0, ends[:-1])
                for i in range(0, len(firsts), BLOCK_UNITS):
                    a, z = firsts[i], ends[min(i + BLOCK_UNITS, len(firsts)) - 1]
                    units = [names[x] for x in firsts[i : i + BLOCK_UNITS]]
                    if units != known[0]:
                        known = (units, _leading([None if x is None else x.encode() for x in units], seed, iterations))
                    # Which draws may lie under the bracket's upper end for any row of the unit: few, and only these are worked out whole.
                    mine = firsts[i : i + BLOCK_UNITS]
                    limit = np.minimum(np.maximum.reduceat(high[a:z], mine - a) >> (DRAW_BITS - 32), (1 << 32) - 1).astype(np.uint32)
                    u, t = np.nonzero(known[1] <= limit[:, None])
                    if not len(u):
                        continue
                    digests = b"".join([md5(heads[y][:-1] if units[x] is None else heads[y] + units[x].encode()).digest() for x, y in zip(u.tolist(), t.tolist(), strict=True)])
                    draws = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
                    # Each of them beside the unit's rows.
                    sizes = np.diff(np.append(mine, z))[u]
                    of = np.repeat(np.arange(len(u)), sizes)
                    row = np.repeat(mine[u] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(len(of))
                    sure = draws[of] < low[row]
                    marked, when = code[row[sure]], t[of[sure]]
                    for k, at in zip(*np.unique(marked, return_index=True), strict=True):
                        key = tuple(part.column(c)[int(row[sure][at])].as_py() for c in keys)
                        if key not in sums:
                            sums[key] = np.zeros(iterations, np.int64)
                        np.add.at(sums[key], when[marked == k], 1)
                    near = ~sure & (draws[of] < high[row])
                    if near.any():
                        r, spots = row[near], (of[near] * 16).tolist()
                        texts = pa.array([digests[x : x + 16].hex() for x in spots], pa.string())
                        taken = part.take(pa.array(r)).combine_chunks()
                        columns = [taken.column(k).combine_chunks() for k in keys]
                        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(r), pa.list_(pa.int64())), taken.column("_unit").combine_chunks(), pa.array(t[of[near]], pa.int32()), texts], names=[*keys, "counts", "_unit", "iter", "_draw"])
                if len(sums) > MOST_ARRAYS:
                    yield from counted()
        yield from counted()

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{fields}, counts array<long>, _unit string, iter int, _draw string")


def subsample_counts(population: DataFrame, unit: str, size: int, iterations: int, seed: str, of: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by, iter, of, n: how many of the rows that `subsamples` draws hold each combination of the columns `of`."""
    kind = population.schema[unit].dataType.simpleString()
    slim, spread, found = saved(population.select(*by, *of, F.col(unit).alias("_id")), "population"), SPREAD, []
    todo: DataFrame | None = None
    # By the draws to be made, which cost more than the rows weigh.
    parts = max(slim.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, slim.count() * iterations // TASK_DRAWS))
    while True:
        groups = _brackets(slim, by, size, spread)
        rows = _sized(slim, groups, by)
        # A unit's rows together, so that its draws are worked out once.
        rows = rows.select(*by, *of, "_low", "_high", "_want", F.col("_id").cast("string").alias("_unit")).repartition(parts, "_unit").sortWithinPartitions("_unit")
        drawn = saved(_count_draws(rows.drop("_want"), seed, iterations, list(by), list(of)), "draws")
        sure = drawn.where("counts is not null").select(*by, *of, F.posexplode("counts").alias("iter", "n")).groupBy(*by, *of, "iter").agg(F.sum("n").alias("n")).where("n > 0")
        near = drawn.where("counts is null").select(*by, *of, "iter", "_draw", F.col("_unit").cast(kind).alias("_unit"))
        totals = sure.select(*by, "iter", F.col("n").alias("sure"), F.lit(0).alias("near")).unionByName(near.groupBy(*by, "iter").agg(F.count("*").alias("near")).select(*by, "iter", F.lit(0).alias("sure"), "near"))
        totals = totals.groupBy(*by, "iter").agg(F.sum("sure").alias("sure"), F.sum("near").alias("near"))
        every = groups.select(*by, F.col("_want").alias("want")).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        totals = saved(_beside(every, totals, [*by, "iter"]).select(*by, "iter", "want", F.coalesce("sure", F.lit(0)).alias("sure"), F.coalesce("near", F.lit(0)).alias("near")), "totals")
        right = (F.col("sure") <= F.col("want")) & (F.col("sure") + F.col("near") >= F.col("want"))
        fine = totals.where(right).select(*by, "iter", (F.col("want") - F.col("sure")).alias("open"))
        if todo is not None:
            fine = _only(fine, todo, [*by, "iter"])
        ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "iter").orderBy("_draw", "_unit")))
        more = _beside(ranked, fine, [*by, "iter"], "inner").where(F.col("_rank") <= F.col("open")).groupBy(*by, *of, "iter").agg(F.count("*").alias("n"))
        both = _only(sure, fine, [*by, "iter"]).unionByName(more.select(*sure.columns))
        found.append(both.groupBy(*by, "iter", *of).agg(F.sum("n").alias("n")))
        missed = totals.where(~right)
        if missed.isEmpty():
            break
        todo, spread = missed.select(*by, "iter"), spread * 4
        slim = _only(slim, missed.select(*by).distinct(), list(by)) if by else slim
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left joined with right's other columns; nulls in `on` are equal."""
    held = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return left.join(held, [left[c].eqNullSafe(held[f"_r_{c}"]) for c in on], how).drop(*[f"_r_{c}" for c in on])


def _only(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    held = right.select(*[F.col(c).alias(f"_r_{c}") for c in on])
    return left.join(held, [left[c].eqNullSafe(held[f"_r_{c}"]) for c in on], "left_semi")


def relabelled(population: DataFrame, unit: str, label: str, iterations: int, seed: str, first: int = 0) -> DataFrame:
    """iter (from `first` on), unit and a label shuffled within the iteration (R8, R11): the k-th unit gets the label of the k-th in md5 order."""
    rows = numbered(population.select(unit, label), [unit], "_k")
    held = saved(rows, "labels")
    bins = 1 << max(0, math.ceil(math.log2(max(1, held.count()) / BIN_ROWS)))
    drawn = held.select(unit, F.col(label).alias("_label"), F.explode(F.sequence(F.lit(first), F.lit(first + iterations - 1))).alias("iter")).withColumn("_draw", _order(seed, unit))
    # The first 32 bits of a draw, in equal parts.
    drawn = drawn.withColumn("_bin", F.shiftright(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") * bins, 32).cast("int"))
    before = Window.partitionBy("iter").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy("iter", "_bin").agg(F.count("*").alias("n")).select("iter", "_bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("iter", "_bin").orderBy("_draw", unit)) - 1
    given = drawn.withColumn("_place", place).join(offsets, ["iter", "_bin"]).select("iter", (F.col("_base") + F.col("_place")).alias("_k"), "_label")
    return given.join(held.select(F.col(unit), "_k"), "_k").select("iter", unit, F.col("_label").alias(label))


def iterate(spark: SparkSession, iterations: int, seed: int, statistic: Callable[[np.random.Generator], float], per_task: int = 50) -> DataFrame:
    """iter, value: one seeded generator an iteration, so results do not depend on the partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            values = [float(statistic(np.random.default_rng([seed, i]))) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.float64())], names=["iter", "value"])

    parts = max(1, -(-iterations // per_task))
    return spark.range(0, iterations, 1, parts).mapInArrow(run, "iter long, value double")


def permutation_test(spark: SparkSession, labels: np.ndarray, statistic: Callable[[np.ndarray], float], iterations: int, seed: int) -> DataFrame:
    """statistic(shuffled labels) for each iteration (R11). Labels travel with the tasks."""
    _bounded(len(labels))
    return iterate(spark, iterations, seed, lambda rng: statistic(rng.permutation(labels)))


def subsample_test(spark: SparkSession, population: np.ndarray, size: int, statistic: Callable[[np.ndarray], float], iterations: int, seed: int) -> DataFrame:
    """statistic(sample without replacement) for each iteration."""
    _bounded(len(population))
    return iterate(spark, iterations, seed, lambda rng: statistic(population[rng.permutation(len(population))[:size]]))


def _bounded(n: int) -> None:
    if n > MOST_POPULATION:
        raise ValueError(f"a population of {n} is too large to send to every task; use subsamples() or relabelled()")


def glm_permutations(spark: SparkSession, x: np.ndarray, y: np.ndarray, iterations: int = 999, seed: int = 0) -> tuple[float, DataFrame]:
    """Observed model mean square and its null under shuffles of y (R2, R3, R26, R27). The projector is worked out once."""
    _bounded(x.size)
    design = np.column_stack([np.ones(len(x)), x])
    q = np.linalg.qr(design)[0]
    df = design.shape[1] - 1
    mean2 = len(y) * y.mean() ** 2
    ms = lambda v: (float(((q.T @ v) ** 2).sum()) - mean2) / df
    return ms(y), permutation_test(spark, y, ms, iterations, seed)


ALLELIC, GENOTYPIC = ("A", "A95", "Ae"), ("Ho", "He")
# Metrics that are named but that resampling does not compute.
OTHER_METRICS = ("F", "Hos", "Hes", "Pe", "Fis", "Undefined")


def level(metric: str) -> str:
    """R19, R20."""
    return "Allelic" if metric in ALLELIC else "Genotypic"


def _larger(genotypes: DataFrame, by: tuple[str, ...], enough: Column) -> DataFrame:
    """The genotypes of the groups for which the condition over n (rows) and alleles (present ones) holds."""
    present = F.when(F.col("a1") != 0, 1).otherwise(0) + F.when(F.col("a2") != 0, 1).otherwise(0)
    groups = genotypes.groupBy(*by).agg(F.count("*").alias("n"), F.sum(present).alias("alleles")).where(enough).select(*by)
    return genotypes.join(groups, list(by), "left_semi") if by else genotypes.join(groups, how="left_semi")


def genotypic_rarefaction(genotypes: DataFrame, metric: str, size: int, iterations: int = 999, seed: str = "0", by: tuple[str, ...] = ()) -> DataFrame | None:
    """iter, value of a metric over subsampled genotypes (ind, a1, a2; 0 is absent) (R17); with `by`, for each of its groups that has more rows."""
    if metric not in ALLELIC + GENOTYPIC or size <= 0 or (not by and genotypes.count() <= size):
        return None
    drawn = subsample_counts(_larger(genotypes, by, F.col("n") > size) if by else genotypes, "ind", size, iterations, seed, ("a1", "a2"), by)
    key = [*by, "iter"]
    alleles = drawn.select(*key, "n", F.explode(F.array("a1", "a2")).alias("a")).where("a <> 0").groupBy(*key, "a").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*key))
    found = alleles.withColumn("p", p).groupBy(*key).agg(F.count("*").cast("double").alias("A"), F.count_if(F.col("p") >= 0.05).cast("double").alias("A95"), F.sum(F.col("p") * F.col("p")).alias("s"))
    whole = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    both = (F.col("a1") != 0) & (F.col("a2") != 0)
    het = drawn.groupBy(*key).agg(whole((F.col("a1") != 0) | (F.col("a2") != 0)).alias("g"), whole(both & (F.col("a1") != F.col("a2"))).alias("h"))
    value = {"A": F.coalesce("A", F.lit(0.0)), "A95": F.coalesce("A95", F.lit(0.0)), "Ae": F.coalesce(1 / F.col("s"), F.lit(0.0)), "Ho": divide(F.col("h"), F.col("g")), "He": 1 - F.coalesce("s", F.lit(0.0))}[metric]
    return het.join(found, key, "left").select(*key, value.alias("value"))


def allelic_rarefaction(genotypes: DataFrame, metric: str, size: int, iterations: int = 999, seed: str = "0", by: tuple[str, ...] = ()) -> DataFrame | None:
    """iter, value over 2 x size alleles drawn from the pool of present ones (R18), with `by` for each of its groups; no rows where the pool is too small."""
    if metric not in ALLELIC:
        return None
    enough = _larger(genotypes, by, (F.lit(size) < 2 * F.col("n")) & (F.lit(2 * size) <= F.col("alleles")))
    pool = enough.select(*by, "ind", F.posexplode(F.array("a1", "a2")).alias("side", "a")).where("a <> 0").select(*by, (F.col("ind") * 2 + F.col("side")).alias("unit"), "a")
    key = [*by, "iter"]
    drawn = subsample_counts(pool, "unit", 2 * size, iterations, seed, ("a",), by).withColumn("p", F.col("n") / (2.0 * size))
    # Squares of counts are whole numbers: their sum does not depend on its order.
    value = {"A": F.count("*").cast("double"), "A95": F.count_if(F.col("p") >= 0.05).cast("double"), "Ae": F.lit(4.0 * size * size) / F.sum(F.col("n") * F.col("n"))}[metric]
    return drawn.groupBy(*key).agg(value.alias("value"))


def rarefaction(genotypes: DataFrame, metric: str, size: int, iterations: int = 999, seed: str = "0", by: tuple[str, ...] = ()) -> DataFrame | None:
    """The metric's null distribution, or null where it is not to be had (R16): fewer than ten drawn, fewer than two iterations, or no genotypes left out."""
    if metric == "Undefined" or iterations < 2 or size < 10 or (not by and size >= genotypes.count()):
        return None
    return (allelic_rarefaction if level(metric) == "Allelic" else genotypic_rarefaction)(genotypes, metric, size, iterations, seed, by)
