"""Text and date scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The components that date() can give, and the lineage colours.
DATE_PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "weekday": F.dayofweek, "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second}


def natural_key(s: Column, digits: int = 20) -> Column:
    """A sort key under which runs of digits compare as numbers and case does not count."""
    runs = F.regexp_extract_all(F.lower(s), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=[0-9])", ""), digits, "0")).otherwise(r)), "")


def date_part(ts: Column, part: str) -> Column:
    """One integer component of a timestamp."""
    return DATE_PARTS[part](ts)


def date_parts(ts: Column, *parts: str) -> Column:
    """Several components as a struct."""
    return F.struct(*[date_part(ts, p).alias(p) for p in parts])


def month_day_year(s: Column) -> Column:
    """MM/dd/yyyy as a timestamp, else null."""
    return F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(F.concat_ws("/", F.lpad(F.split(s, "/")[0], 2, "0"), F.lpad(F.split(s, "/")[1], 2, "0"), F.split(s, "/")[2]), F.lit("MM/dd/yyyy")))


def hex_colour(s: Column) -> Column:
    """#RRGGBB as red, green, blue in [0, 1]; null if malformed."""
    body = F.regexp_replace(s, "^#", "")
    part = lambda i: F.conv(F.substring(body, i, 2), 16, 10).cast("double") / 255.0
    return F.when(body.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("red"), part(3).alias("green"), part(5).alias("blue")))


def json_scalar(json: Column, path: str) -> Column:
    """A JSON scalar as text: booleans as true or false, null as null."""
    return F.get_json_object(json, path)


def json_number(json: Column, path: str) -> Column:
    """A JSON scalar as a double if it is a number, else null."""
    return F.try_variant_get(F.try_parse_json(json), path, "double")


def lineage_colour(lineage: Column) -> Column:
    """The colour name of an allele's lineage code."""
    return F.when(lineage == -1, "pink").when(lineage == 1, "blue").when(lineage == 2, "orange").when(lineage == 3, "red").otherwise("primary")
