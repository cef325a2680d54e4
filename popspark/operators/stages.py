"""Tables written between the steps of an iterative or global computation, and global numbering.

Written tables cut lineage and survive lost executors; nothing here keeps a table in memory.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range that one task numbers, about, and ranges at most: so many counts go through the driver.
RANGE_ROWS, MOST_RANGES = 500_000, 10_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in a local session without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="popspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def unique() -> str:
    """A part of a path that no other run has."""
    return uuid.uuid4().hex


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{unique()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", start: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with its rows' places in the order, from `start` on without gaps; rows that tie are numbered in any one order.

    Rows are dealt to ranges of the order, counted by range, and numbered within
    their range after the sum of the ranges before: no task sees the whole table.
    Ties are dealt by a row's place in the written table, so a value that many rows
    share is cut too.
    """
    taken = {c.lower() for c in df.columns}
    tie, part = (next(n for n in (f"{'_' * k}{x}" for k in range(1, 99)) if n.lower() not in taken) for x in ("tie", "range"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = saved(df.withColumn(tie, F.monotonically_increasing_id()), "rows")
    n = rows.count()
    parts = min(MOST_RANGES, max(1, -(-n // range_rows)))
    if parts == 1:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys, tie)) - 1 + F.lit(start).cast("long")).drop(tie)
    ranged = saved(rows.repartitionByRange(parts, *keys, F.col(tie)).withColumn(part, F.spark_partition_id()), "ranges")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())
    before, offsets = start, []
    for p, k in counts:
        offsets.append((p, before))
        before += k
    base = df.sparkSession.createDataFrame(offsets, f"{part} int, {name} long")
    within = F.row_number().over(Window.partitionBy(part).orderBy(*keys, tie)) - 1
    return ranged.withColumn(f"{part}_n", within).join(F.broadcast(base), part).withColumn(name, F.col(name) + F.col(f"{part}_n")).drop(tie, part, f"{part}_n")
