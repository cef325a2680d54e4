"""Tables with roles, and the transforms that feed charts.

Covers P1-P10, K3, K14, A13-A21, S13-S17, R35, J1, V1-V12, E13, E51, E52.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popspark.functions.text import DATE_PARTS
from popspark.functions.vectors import nan

from .quantiles import quantiles

ROLES = ("x", "y", "series", "label")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def kind_of(dtype: T.DataType) -> str | None:
    """number, date or category (P5)."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "category" if isinstance(dtype, T.StringType) else None


@dataclass(frozen=True)
class RoleFrame:
    """A DataFrame and which of its columns play x, y, series and label. row_id orders rows where order matters."""

    df: DataFrame
    roles: dict[str, str] = field(default_factory=dict)
    row_id: str | None = None

    def role(self, name: str, column: str) -> RoleFrame:
        """The same table with one role bound anew."""
        if name not in ROLES:
            raise ValueError(f"no role {name}")
        return replace(self, roles=self.roles | {name: column})

    def kind(self, column: str) -> str | None:
        return kind_of(self.df.schema[column].dataType) if column in self.df.columns else None

    @property
    def x_kind(self) -> str | None:
        """P10."""
        return self.kind(self.roles["x"]) if "x" in self.roles else None

    @property
    def column_names(self) -> list[str]:
        """P7."""
        return self.df.columns

    def row_count(self) -> int:
        """P6."""
        return self.df.count()

    def column(self, name: str) -> DataFrame:
        """A numeric column without its nulls; NaN stays; no rows if not numeric."""
        if self.kind(name) != "number":
            return self.df.select(F.lit(None).cast("double").alias(name)).limit(0)
        return self.df.select(F.col(name).cast("double").alias(name)).where(F.col(name).isNotNull())

    def numeric(self, name: str) -> Column:
        """P2."""
        return F.col(name).cast("double")

    def string(self, name: str) -> Column:
        """P3."""
        return F.col(name).cast("string")

    def plot_value(self, name: str) -> Column:
        """The value tagged by its kind: kind, number, date, category."""
        kind, c = self.kind(name), F.col(name)
        pick = lambda k, t: (c.cast(t) if kind == k else F.lit(None).cast(t)).alias(k)
        return F.struct(F.lit(kind).alias("kind"), pick("number", "double"), pick("date", "timestamp"), pick("category", "string"))

    def series_values(self) -> DataFrame:
        """Distinct non-null series, sorted."""
        c = self.roles["series"]
        return self.df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)

    def plot_rows(self) -> DataFrame:
        """id, x, y and the bound series and label: rows with an x and a finite y; none unless x and y are bound."""
        if not {"x", "y"} <= set(self.roles):
            return empty_xy(self.df.sparkSession)
        x, y = self.roles["x"], F.col(self.roles["y"]).cast("double")
        more = [F.col(self.roles[r]).cast("string").alias(r) for r in ("series", "label") if r in self.roles]
        ids = [F.col(self.row_id).alias("id")] if self.row_id else []
        return self.df.where(F.col(x).isNotNull() & finite(y)).select(*ids, F.col(x).alias("x"), y.alias("y"), *more)


def empty_xy(spark: SparkSession) -> DataFrame:
    """E51."""
    return spark.createDataFrame([], "x double, y double")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> RoleFrame:
    """A headed CSV file with the given or else the found types."""
    reader = spark.read.option("header", True)
    return RoleFrame(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))


def write_csv(t: RoleFrame, path: str) -> None:
    """K3."""
    t.df.write.mode("errorifexists").option("header", True).csv(path)


def from_columns(spark: SparkSession, numbers: dict | None = None, dates: dict | None = None, strings: dict | None = None) -> RoleFrame:
    """Columns by kind, each kind in alphabetical order."""
    kinds = [(n, v, t) for group, t in ((numbers, "double"), (dates, "timestamp"), (strings, "string")) for n, v in sorted((group or {}).items())]
    rows = list(zip(*[[float(x) if t == "double" and x is not None else x for x in v] for _, v, t in kinds], strict=True))
    return RoleFrame(spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, _, t in kinds)))


def from_matrix(m: DataFrame, names: list[str], labels: DataFrame | None = None) -> RoleFrame:
    """A long matrix as a wide table with its row label (S16). `names` are the columns' names in order of j."""
    wide = m.groupBy("i").pivot("j", list(range(len(names)))).agg(F.first("value"))
    wide = wide.select("i", *[F.col(f"`{j}`").alias(n) for j, n in enumerate(names)])
    wide = wide.join(labels.select("i", "label"), "i", "left") if labels is not None else wide.withColumn("label", F.col("i").cast("string"))
    return RoleFrame(wide, {"label": "label"}, "i")


def from_vector(df: DataFrame, vector: str, name: str = "value") -> RoleFrame:
    """One row for each element, bound to y."""
    return RoleFrame(df.select(F.posexplode(vector).alias("row_id", name)), {"y": name}, "row_id")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A13, A14."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").cast("double").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, lower, upper, center, n over equal-width bins, each [lower, upper) but the last, which is closed.

    Edges are low + bin x width, and a value belongs to the bin whose computed
    edges hold it. Only the value's own bin and its neighbours are tried, so values
    are aggregated by bin without a join. No finite range gives no bin; a single
    value gives one bin.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high")).where(F.col("low").isNotNull())
    ends = ends.withColumn("bins", F.when(F.col("high") > F.col("low"), F.lit(bins)).otherwise(1))
    ends = ends.withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    lower = lambda k: F.col("low") + k * F.col("width")
    inside = lambda k: (F.col("v") >= lower(k)) & (F.when(k == F.col("bins") - 1, F.col("v") <= F.col("high")).otherwise(F.col("v") < lower(k) + F.col("width"))) & k.between(0, F.col("bins") - 1)
    guess = F.when(F.col("width") > 0, F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.col("bins") - 1)).otherwise(0).cast("int")
    placed = v.crossJoin(F.broadcast(ends)).withColumn("g", guess)
    placed = placed.withColumn("bin", F.explode(F.filter(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1), inside)))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    table = ends.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    lo = F.col("low") + F.col("bin") * F.col("width")
    return table.join(counts, "bin", "left").select("bin", lo.alias("lower"), (lo + F.col("width")).alias("upper"), (lo + F.col("width") / 2).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def frequency(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """bucket, n for each integer of [low, high], values rounded half away from zero."""
    rounded = F.round(F.col(column).cast("double")).cast("int")
    counts = df.select(rounded.alias("bucket")).where(F.col("bucket").between(low, high)).groupBy("bucket").agg(F.count("*").alias("n"))
    buckets = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("bucket"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def seven_numbers(df: DataFrame, column: str) -> DataFrame:
    """statistic, value in the order Count, Min, Q1, Median, Mean, Q3, Max; quartiles interpolate."""
    c = F.col(column).cast("double")
    one = df.where(c.isNotNull()).agg(F.count(c).cast("double").alias("a"), F.min(c).alias("b"), F.avg(c).alias("m"), F.max(c).alias("z"))
    one = one.join(F.broadcast(quantiles(df, [], c, [0.25, 0.5, 0.75]).select("q")), F.lit(True), "left")  # one row each
    names = ["Count", "Min", "Q1", "Median", "Mean", "Q3", "Max"]
    values = ["a", "b", "q[0]", "q[1]", "m", "q[2]", "z"]
    pairs = ", ".join(f"{i}, '{n}', {v}" for i, (n, v) in enumerate(zip(names, values, strict=True)))
    return one.selectExpr(f"stack(7, {pairs}) as (place, statistic, value)").withColumn("value", F.coalesce("value", nan()))


def collapsed(df: DataFrame, ts: str, y: str, part: str) -> DataFrame:
    """Sums of y by the value of a date component, so a month meets all its years."""
    v = F.col(y).cast("double")
    return df.where(F.col(ts).isNotNull() & finite(v)).groupBy(DATE_PARTS[part](ts).alias(part)).agg(F.sum(v).alias("total"))


def box_summary(df: DataFrame, category: str, y: str) -> DataFrame:
    """category, median and sample sd of its finite values."""
    v = F.col(y).cast("double")
    rows = df.where(F.col(category).isNotNull() & finite(v)).select(F.col(category).alias("category"), v.alias("y"))
    medians = quantiles(rows, ["category"], "y", [0.5]).select("category", F.get("q", F.lit(0)).alias("median"))
    return medians.join(rows.groupBy("category").agg(F.coalesce(F.stddev_samp("y"), nan()).alias("sd")), "category")


def box_plot(df: DataFrame, category: str, y: str) -> DataFrame:
    """Box of one sd and whiskers of two about the median (V2)."""
    m, s = F.col("median"), F.col("sd")
    return box_summary(df, category, y).select("category", "median", (m - s).alias("box_low"), (m + s).alias("box_high"), (m - 2 * s).alias("whisker_low"), (m + 2 * s).alias("whisker_high"))


def trendline(df: DataFrame, x: str, slope: float, intercept: float) -> DataFrame:
    """The line's two end points at the least and the largest x."""
    c = F.col(x).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where(F.col("lo").isNotNull())
    return ends.select(F.explode(F.array("lo", "hi")).alias("x")).withColumn("y", F.lit(float(intercept)) + F.col("x") * float(slope))


def pairwise_join(measures: list[tuple[DataFrame, str]]) -> DataFrame:
    """GroupA, GroupB and a column for each measure; names must differ."""
    names = [n for _, n in measures]
    if len(set(names)) < len(names):
        raise ValueError("measures need distinct column names")
    parts = [d.select("GroupA", "GroupB", n) for d, n in measures]
    return reduce(lambda a, b: a.join(b, ["GroupA", "GroupB"]), parts)


def bar_rows(t: RoleFrame) -> DataFrame:
    """Categories (numbers without decimals) and y (V1)."""
    rows = t.plot_rows()
    return rows.withColumn("x", F.format_string("%.0f", F.col("x").cast("double"))) if t.x_kind == "number" else rows.withColumn("x", F.col("x").cast("string"))


def distribution_rows(rows: DataFrame) -> DataFrame:
    """Plot rows with zero end points half a unit outside (V3)."""
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("lo").isNotNull())
    pad = ends.select(F.explode(F.array(F.col("lo") - 0.5, F.col("hi") + 0.5)).alias("x")).withColumn("y", F.lit(0.0))
    return rows.select(F.col("x").cast("double").alias("x"), "y").unionByName(pad)


def y_rows(t: RoleFrame) -> DataFrame:
    """Finite y with its label, x being unbound: what pie and number-line charts need (V5, V6)."""
    y = F.col(t.roles["y"]).cast("double")
    label = F.col(t.roles["label"]).cast("string") if "label" in t.roles else F.lit(None).cast("string")
    return t.df.where(finite(y)).select(label.alias("label"), y.alias("y"))


def number_line_domain(t: RoleFrame) -> DataFrame:
    """0 to 1.1 times the largest y (V5)."""
    return y_rows(t).agg(F.lit(0.0).alias("low"), (F.max("y") * 1.1).alias("high"))


def time_series_rows(t: RoleFrame) -> DataFrame:
    """Plot rows and whether they are grouped: two series or more."""
    rows = t.plot_rows()
    if "series" not in t.roles:
        return rows.withColumn("grouped", F.lit(False))
    n = rows.agg((F.count_distinct("series") >= 2).alias("grouped"))
    return rows.crossJoin(F.broadcast(n))


def stats_row(df: DataFrame, column: str) -> DataFrame:
    """n, sum, mean, min, max of a column."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("n"), F.coalesce(F.sum(c), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(c), nan()).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def formatted(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Every cell as text, doubles with fixed decimals."""
    show = lambda f: F.format_string(f"%.{decimals}f", F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name).cast("string")
    return df.select(*[F.coalesce(show(f), F.lit("")).alias(f.name) for f in df.schema])


def sample_scatter(spark: SparkSession, n: int = 20) -> RoleFrame:
    """A small reproducible scatter."""
    x = F.col("id").cast("double")
    return RoleFrame(spark.range(n).select("id", x.alias("x"), (2 * x + F.sin(x)).alias("y")), {"x": "x", "y": "y"}, "id")
