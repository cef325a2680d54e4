"""Coordinates: distances, boxes, hulls."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import natural_key
from .vectors import nan

EARTH_KM = 6371.0088  # mean radius; distances are haversine on this sphere
WORLD = 268435456.0  # fixed value: map points across the Web Mercator square


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km (X1); null if a coordinate is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    # least() passes over nulls, so a missing coordinate is kept out of it.
    return F.when(a.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0))))


def is_spatial(lat: Column, lon: Column) -> Column:
    """Both coordinates are there."""
    return lat.isNotNull() & lon.isNotNull()


def located(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Only rows with coordinates."""
    return df.dropna(subset=[lat, lon])


def placards(df: DataFrame, title: str = "name", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Located rows as title and subtitle; one for each coordinate."""
    text = F.format_string("%.4f, %.4f", F.col(lat), F.col(lon))
    return located(df, lat, lon).select(F.col(title).alias("title"), text.alias("subtitle"), F.col(lat).alias("latitude"), F.col(lon).alias("longitude")).dropDuplicates(["latitude", "longitude"])


def bounds(df: DataFrame, *by: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Bounding box and its midpoint, over all rows or for each group; NaN if nothing is located."""
    agg = lambda f, c: F.coalesce(f(c), nan())
    box = located(df, lat, lon).groupBy(*by).agg(agg(F.min, lon).alias("min_lon"), agg(F.max, lon).alias("max_lon"), agg(F.min, lat).alias("min_lat"), agg(F.max, lat).alias("max_lat"))
    return box.withColumn("center_lon", (F.col("min_lon") + F.col("max_lon")) * 0.5).withColumn("center_lat", (F.col("min_lat") + F.col("max_lat")) * 0.5)


def region(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Centre and span, across the antimeridian if that is narrower; one point spans a degree."""
    east = F.when(F.col(lon) < 0, F.col(lon) + 360).otherwise(F.col(lon))
    agg = located(df, lat, lon).agg(*[f(c).alias(n) for n, c in (("lat", F.col(lat)), ("lon", F.col(lon)), ("east", east)) for f, n in ((F.min, f"lo_{n}"), (F.max, f"hi_{n}"))])
    plain, shifted = F.col("hi_lon") - F.col("lo_lon"), F.col("hi_east") - F.col("lo_east")
    mid_east = (F.col("hi_east") + F.col("lo_east")) / 2
    centre = F.when(plain <= shifted, (F.col("hi_lon") + F.col("lo_lon")) / 2).otherwise(F.when(mid_east > 180, mid_east - 360).otherwise(mid_east))
    single = (F.col("lo_lat") == F.col("hi_lat")) & (plain == 0)
    return agg.where(F.col("lo_lat").isNotNull()).select(((F.col("lo_lat") + F.col("hi_lat")) / 2).alias("center_lat"), centre.alias("center_lon"), F.when(single, 1.0).otherwise(F.col("hi_lat") - F.col("lo_lat")).alias("span_lat"), F.when(single, 1.0).otherwise(F.least(plain, shifted)).alias("span_lon"))


def with_buffer(df: DataFrame, scale: float = 1.1) -> DataFrame:
    """The region with its span scaled about the same centre."""
    return df.withColumn("span_lat", F.col("span_lat") * scale).withColumn("span_lon", F.col("span_lon") * scale)


def mercator_rect(df: DataFrame) -> DataFrame:
    """Origin and size of a region in Web Mercator map points."""
    x = lambda lon: (lon + 180.0) / 360.0 * WORLD
    y = lambda lat: (F.lit(0.5) - F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) / (2 * math.pi)) * WORLD
    west, east = F.col("center_lon") - F.col("span_lon") / 2, F.col("center_lon") + F.col("span_lon") / 2
    north, south = F.col("center_lat") + F.col("span_lat") / 2, F.col("center_lat") - F.col("span_lat") / 2
    return df.select(x(west).alias("x"), y(north).alias("y"), (x(east) - x(west)).alias("width"), (y(south) - y(north)).alias("height"))


def pairwise_distances(groups: DataFrame, name: str = "name", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """GroupA, GroupB, km for located groups, A before B in natural order (J13). One row a pair of groups: groups are few."""
    rows = located(groups, lat, lon).select(F.col(name).alias("n"), natural_key(F.col(name)).alias("k"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    a, b = rows.alias("a"), rows.alias("b")
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.struct("a.k", "a.n") < F.struct("b.k", "b.n")).select(F.col("a.n").alias("GroupA"), F.col("b.n").alias("GroupB"), km.alias("km"))


def physical_distance(nodes: DataFrame, key: str = "id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Distance of every ordered pair; infinite where a coordinate is missing, on the diagonal too."""
    a = nodes.select(F.col(key).alias("source"), F.col(lat).alias("lat_a"), F.col(lon).alias("lon_a"))
    b = nodes.select(F.col(key).alias("target"), F.col(lat).alias("lat_b"), F.col(lon).alias("lon_b"))
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.crossJoin(b).select("source", "target", F.coalesce(km, F.lit(float("inf"))).alias("km"))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """clockwise, counterclockwise or collinear turn a-b-c, by the cross product."""
    cross = (by - ay) * (cx - bx) - (bx - ax) * (cy - by)
    return F.when(F.abs(cross) < 1e-10, "collinear").when(cross > 0, "clockwise").otherwise("counterclockwise")


def hull_points(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counterclockwise from the leftmost (of equals the highest); none below three points."""
    unique = sorted(set(points))
    if len(points) < 3 or len(unique) < 3:
        return []

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 1e-10:
                out.pop()
            out.append(p)
        return out

    ring = chain(unique)[:-1] + chain(unique[::-1])[:-1]
    start = min(range(len(ring)), key=lambda i: (ring[i][0], -ring[i][1]))
    return ring[start:] + ring[:start] if len(ring) > 2 else []


def convex_hull(df: DataFrame, by: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Hull corners of each group in order (X2). Each task first drops all but its own hulls' corners, so a group gathers few points."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, longitude double, latitude double"

    def partial(batches):
        for batch in batches:
            groups: dict = {}
            for g, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                groups.setdefault(g, []).append((x, y))
            rows = [(g, *p) for g, pts in groups.items() for p in (hull_points(pts) or sorted(set(pts)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], batch.column(i).type) for i in range(3)], names=[by, "longitude", "latitude"])

    def final(table: pa.Table) -> pa.Table:
        ring = hull_points(list(zip(table.column("longitude").to_pylist(), table.column("latitude").to_pylist(), strict=True)))
        keys = pa.array([table.column(by)[0].as_py()] * len(ring), table.schema.field(by).type)
        return pa.table({by: keys, "corner": pa.array(range(len(ring)), pa.int32()), "longitude": pa.array([p[0] for p in ring], pa.float64()), "latitude": pa.array([p[1] for p in ring], pa.float64())})

    slim = located(df, lat, lon).select(by, F.col(lon).cast("double").alias("longitude"), F.col(lat).cast("double").alias("latitude"))
    return slim.mapInArrow(partial, schema).groupBy(by).applyInArrow(final, schema.replace(", longitude", ", corner int, longitude"))


def polygon_text(hull: DataFrame, by: str) -> DataFrame:
    """Each hull as a closed WKT polygon."""
    point = F.concat_ws(" ", F.col("longitude").cast("string"), F.col("latitude").cast("string"))
    ring = hull.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", point.alias("p")))), lambda s: s["p"]).alias("ring"))
    return ring.select(by, F.concat(F.lit("POLYGON(("), F.array_join(F.concat("ring", F.slice("ring", 1, 1)), ", "), F.lit("))")).alias("polygon"))
