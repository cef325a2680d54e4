"""Vectors: arrays of doubles, one a row (survey rows A1-A7, M1-M25, E7, E14, E15).

Missing results follow one rule: a statistic that is undefined is NaN; a value that
does not exist is null. Division by zero gives infinity or NaN, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def divide(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles do it."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when((a == 0) | F.isnan(a), nan()).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def array_sum(v: Column) -> Column:
    """Sum; 0 for an empty vector."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    """Mean; NaN for an empty vector."""
    return divide(array_sum(v), F.size(v))


def variance(v: Column) -> Column:
    """Sample variance; NaN below two values (A3)."""
    m = mean(v)
    squares = F.aggregate(F.zip_with(v, F.array_repeat(m, F.size(v)), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(v) < 2, nan()).otherwise(divide(squares, F.size(v) - 1))


def sd(v: Column) -> Column:
    """Sample standard deviation."""
    return F.sqrt(variance(v))


def magnitude(v: Column) -> Column:
    """Euclidean norm (A5)."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def minimum(v: Column) -> Column:
    """Smallest value; null for an empty vector."""
    return F.array_min(v)


def maximum(v: Column) -> Column:
    """Largest value; null for an empty vector."""
    return F.array_max(v)


def scalar(v: Column, op: str, s: Column | float) -> Column:
    """v op s for each element; op is one of + - * / (M1-M4)."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(v, lambda x: _apply(x, op, s))


def elementwise(a: Column, op: str, b: Column) -> Column:
    """a op b by position, as long as a; missing elements of b are null (M5-M8)."""
    return F.slice(F.zip_with(a, b, lambda x, y: _apply(x, op, y)), 1, F.greatest(F.size(a), F.lit(0)))


def _apply(x: Column, op: str, y: Column) -> Column:
    if op == "/":
        return divide(x, y)
    return {"+": x + y, "-": x - y, "*": x * y}[op]


def dot(a: Column, b: Column) -> Column:
    """Inner product (M9)."""
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def equal(a: Column, b: Column) -> Column:
    """Equal length, and no element apart by more than the least normal double."""
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 2.2250738585072014e-308), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(a) == F.size(b)) & close


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences."""
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_distance(a, b))


def half_squared_distance(a: Column, b: Column) -> Column:
    """Half the squared distance, as the variance decomposition uses it."""
    return squared_distance(a, b) / 2


def component(v: Column, i: int) -> Column:
    """Element i (x, y, z are 0, 1, 2); 0 if the vector is shorter."""
    return F.coalesce(F.get(v, F.lit(i)), F.lit(0.0))


def point(v: Column, dimensions: int) -> Column:
    """The first components as a zero-filled vector."""
    return F.array(*[component(v, i) for i in range(dimensions)])


def normal(v: Column) -> Column:
    """The vector over its norm."""
    return F.transform(v, lambda x: divide(x, magnitude(v)))


def smallest(a: Column, b: Column) -> Column:
    """Element minima; a itself if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.least(x, y))).otherwise(a)


def largest(a: Column, b: Column) -> Column:
    """Element maxima; a itself if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.greatest(x, y))).otherwise(a)


def constrain(v: Column, low: float, high: float) -> Column:
    """Every element within [low, high]."""
    return F.transform(v, lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def limit_magnitude(v: Column, most: float) -> Column:
    """Every element cut to `most` in size, with its sign."""
    return F.transform(v, lambda x: F.signum(x) * F.least(F.lit(float(most)), F.abs(x)))


def min_max_scaled(v: Column) -> Column:
    """(x - min) / (max - min); null for an empty or constant vector."""
    low, high = F.array_min(v), F.array_max(v)
    return F.when((F.size(v) > 0) & (high > low), F.transform(v, lambda x: (x - low) / (high - low)))


def zeros(n: int | Column) -> Column:
    """n zeros (M21)."""
    return F.array_repeat(F.lit(0.0), n)


def random(n: int, kind: str = "uniform", seed: int = 0) -> Column:
    """n draws: uniform in [0, 1), signed in [-1, 1), or normal."""
    draw = {"uniform": lambda i: F.rand(seed + i), "signed": lambda i: 2 * F.rand(seed + i) - 1, "normal": lambda i: F.randn(seed + i)}[kind]
    return F.array(*[draw(i) for i in range(n)])


def random_unit(n: int = 512, seed: int = 0) -> Column:
    """A random vector of norm 1 (M23). Bound to a name first: written twice, the draws would be made twice."""
    return F.element_at(F.transform(F.array(random(n, "signed", seed)), normal), 1)


def within(low: float, high: float, seed: int = 0) -> Column:
    """A uniform draw from [low, high]."""
    return F.lit(float(low)) + F.rand(seed) * (high - low)


def hashed_unit(*parts: Column | str | int) -> Column:
    """A reproducible draw in [0, 1) from the md5 of the parts (M25): the same in any SQL engine, whatever the partitioning."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def r_vector(v: Column) -> Column:
    """The vector as R source, c(1.0, 2.0) (K4)."""
    return F.concat(F.lit("c("), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit(")"))
