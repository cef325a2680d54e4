import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from popspark.functions import spatial, text, vectors
from popspark.operators import tables


def one(spark, schema, row, **columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_vector_functions(spark):
    a, b = F.col("a"), F.col("b")
    r = one(
        spark, "a array<double>, b array<double>", ([3.0, 4.0], [1.0, 2.0]),
        total=vectors.array_sum(a), mean=vectors.mean(a), var=vectors.variance(a), sd=vectors.sd(a), norm=vectors.magnitude(a), low=vectors.minimum(a), high=vectors.maximum(a), plus=vectors.scalar(a, "+", 1), over=vectors.scalar(a, "/", 0), add=vectors.elementwise(a, "+", b), div=vectors.elementwise(a, "/", b), dot=vectors.dot(a, b),
        dist=vectors.distance(a, b), half=vectors.half_squared_distance(a, b), unit=vectors.normal(a), small=vectors.smallest(a, b), large=vectors.largest(a, b), clamp=vectors.constrain(a, 0, 3.5), limit=vectors.limit_magnitude(vectors.scalar(a, "*", -1), 3), scaled=vectors.min_max_scaled(a), z=vectors.component(a, 2), p3=vectors.point(a, 3), same=vectors.equal(a, a), differ=vectors.equal(a, b), r=vectors.r_vector(b),
    )
    assert (r.total, r["mean"], r["var"], r.norm, r.low, r.high, r.dot, r.half) == (7, 3.5, 0.5, 5, 3, 4, 11, 4)
    assert r.plus == [4, 5] and r.over == [math.inf, math.inf] and r["add"] == [4, 6] and r["div"] == [3, 2] and r.unit == [0.6, 0.8]
    assert r.small == [1, 2] and r.large == [3, 4] and r.clamp == [3, 3.5] and r["limit"] == [-3, -3] and r.scaled == [0, 1]
    assert r.z == 0 and r.p3 == [3, 4, 0] and r.same and not r.differ and r.r == "c(1.0, 2.0)" and math.isclose(r.dist, math.sqrt(8))


def test_empty_and_degenerate_vectors(spark):
    e = F.col("e")
    r = one(spark, "e array<double>, c array<double>", ([], [2.0]), total=vectors.array_sum(e), mean=vectors.mean(e), var=vectors.variance(F.col("c")), low=vectors.minimum(e), scaled=vectors.min_max_scaled(F.col("c")), other=vectors.smallest(e, F.col("c")), zero=vectors.divide(F.lit(0.0), F.lit(0.0)), minus=vectors.divide(F.lit(-1.0), F.lit(0.0)))
    assert r.total == 0 and math.isnan(r["mean"]) and math.isnan(r["var"]) and r.low is None and r.scaled is None and r.other == [] and math.isnan(r.zero) and r.minus == -math.inf


def test_natural_order(spark):
    names = ["10", "2", "A10", "a2", "B1", "1b", "A1", "b", "a02x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n")), "n").collect()] == ["1b", "2", "10", "A1", "a2", "a02x", "A10", "b", "B1"]


def test_dates_colours_json(spark):
    r = one(spark, "a string, b string, c string, j string", ("01/31/2024", "31/01/2024x", "#FF8000", '{"n": 1.5, "s": "x", "b": true}'), good=text.month_day_year(F.col("a")), bad=text.month_day_year(F.col("b")), colour=text.hex_colour(F.col("c")), none=text.hex_colour(F.col("a")), n=text.json_number(F.col("j"), "$.n"), s=text.json_number(F.col("j"), "$.s"), b=text.json_scalar(F.col("j"), "$.b"))
    assert r.good == datetime.datetime(2024, 1, 31) and r.bad is None and r.none is None
    assert (r.colour.red, r.colour.blue, r.n, r.s, r.b) == (1, 0, 1.5, None, "true") and math.isclose(r.colour.green, 128 / 255)


def test_frequency_and_histogram_goldens(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 3, 3, 9)], "x double")
    assert [r.n for r in tables.frequency(df, "x", 1, 5).orderBy("bucket").collect()] == [1, 2, 3, 0, 0]
    assert [r.bucket for r in tables.frequency(spark.createDataFrame([(2.5,), (-2.5,)], "x double"), "x", -3, 3).where("n > 0").orderBy("bucket").collect()] == [-3, 3]
    assert [r.n for r in tables.histogram(df, "x", 4).orderBy("bin").collect()] == [3, 3, 0, 1]
    assert [r.n for r in tables.histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x").collect()] == [3]
    assert tables.histogram(df.limit(0), "x").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.integers(1, 9))
def test_histogram_follows_its_edges(spark, values, bins):
    low, high = min(values), max(values)
    bins = bins if high > low else 1
    width = (high - low) / bins
    want = [sum(low + k * width <= v and (v <= high if k == bins - 1 else v < low + k * width + width) for v in values) for k in range(bins)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.n for r in tables.histogram(df, "x", bins).orderBy("bin").collect()] == want


def test_summary_box_collapse_goldens(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    assert [r.value for r in tables.seven_numbers(df, "x").orderBy("place").collect()] == [10, 1, 3.25, 5.5, 5.5, 7.75, 10]
    box = spark.createDataFrame([("A", 10.0), ("A", 20.0), ("A", 30.0), ("B", 100.0), ("B", 200.0), ("B", 300.0), ("B", math.nan)], "c string, y double")
    assert {r.category: r["median"] for r in tables.box_summary(box, "c", "y").collect()} == {"A": 20, "B": 200}
    day = datetime.datetime
    dated = spark.createDataFrame([(day(2024, 1, 1), 10.0), (day(2024, 5, 1), 5.0), (day(2025, 1, 1), 7.0), (None, 1.0), (day(2025, 1, 1), math.inf)], "t timestamp, y double")
    assert {r.year: r.total for r in tables.collapsed(dated, "t", "y", "year").collect()} == {2024: 15, 2025: 7}
    assert {r.month: r.total for r in tables.collapsed(dated, "t", "y", "month").collect()} == {1: 17, 5: 5}


def test_roles_and_plot_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, "a"), (1, None, 2.0, "a"), (2, 3.0, math.nan, "b"), (3, 4.0, None, None)], "id int, x double, y double, s string")
    t = tables.RoleFrame(df, row_id="id").role("x", "x").role("y", "y").role("series", "s")
    assert [r.id for r in t.plot_rows().collect()] == [0] and t.x_kind == "number" and t.kind("s") == "category" and t.column_names == df.columns
    assert [r.s for r in t.series_values().collect()] == ["a", "b"]
    assert tables.RoleFrame(df, {"y": "y"}).plot_rows().count() == 0
    assert t.column("y").count() == 3 and t.column("s").count() == 0
    assert tables.y_rows(t).count() == 2 and not tables.time_series_rows(t).first().grouped
    with pytest.raises(ValueError):
        t.role("w", "x")
    made = tables.from_columns(spark, {"b": [1, 2], "a": [3, None]}, strings={"s": ["x", None]})
    assert made.df.columns == ["b", "a", "s"] or made.df.columns == ["a", "b", "s"]


def test_pairwise_join(spark):
    a = spark.createDataFrame([("x", "y", 1.0), ("x", "z", 2.0)], "GroupA string, GroupB string, p double")
    b = spark.createDataFrame([("x", "y", 3.0)], "GroupA string, GroupB string, q double")
    assert [tuple(r) for r in tables.pairwise_join([(a, "p"), (b, "q")]).collect()] == [("x", "y", 1.0, 3.0)]
    with pytest.raises(ValueError):
        tables.pairwise_join([(a, "p"), (a, "p")])


def test_csv_round_trip(spark, tmp_path):
    t = tables.sample_scatter(spark)
    tables.write_csv(t, str(tmp_path / "t"))
    assert tables.read_csv(spark, str(tmp_path / "t"), "id long, x double, y double").row_count() == 20


def test_spatial(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", None, 2.0)], "name string, latitude double, longitude double")
    km = spatial.pairwise_distances(df).first().km
    assert 100 < km < 120 and spatial.located(df).count() == 2 and spatial.pairwise_distances(df).count() == 1
    cross = {(r.source, r.target): r.km for r in spatial.physical_distance(df, "name").collect()}
    assert cross["c", "c"] == math.inf and cross["a", "a"] == 0 and len(cross) == 9
    r = spatial.region(spark.createDataFrame([(0.0, 179.0), (0.0, -179.0)], "latitude double, longitude double")).first()
    assert r.span_lon == 2 and abs(r.center_lon) == 180
    single = spatial.region(spark.createDataFrame([(5.0, 6.0)], "latitude double, longitude double")).first()
    assert (single.span_lat, single.span_lon) == (1, 1)
    b = spatial.bounds(df.limit(0)).first()
    assert math.isnan(b.min_lon) and math.isnan(b.center_lat)
    rect = spatial.mercator_rect(spatial.region(df)).first()
    assert rect.width > 0 and rect.x > 0


def test_convex_hull(spark):
    pts = [("g", float(x), float(y)) for x in range(4) for y in range(4)] + [("h", 0.0, 0.0), ("h", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g string, longitude double, latitude double").repartition(3)
    hull = spatial.convex_hull(df, "g")
    assert {(r.longitude, r.latitude) for r in hull.collect()} == {(0, 0), (3, 0), (3, 3), (0, 3)}
    first = hull.orderBy("corner").first()
    assert (first.longitude, first.latitude) == (0, 3)
    assert spatial.polygon_text(hull, "g").first().polygon.startswith("POLYGON((0.0 3.0, ")
    turn = spark.range(1).select(spatial.orientation(*map(F.lit, (0.0, 0.0, 1.0, 0.0, 1.0, 1.0))).alias("t")).first().t
    assert turn == "counterclockwise"
