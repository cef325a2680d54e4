"""Helpers that the corpus operators share: words, shared storage, row keys."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what is neither a space nor one of the controls from tab to carriage return.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str = SPACE_RUN) -> Column:
    """The words between runs of separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def majority(hashes: np.ndarray) -> int:
    """The SimHash of unsigned 64-bit hashes: bit b is 1 if it is in over half of them."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent (a local session, as in tests) a
    temporary folder of this machine is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="popspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept[T](key: tuple, make: Callable[[], T]) -> T:
    """What make() gave for the key in this Python process, so that a worker keeps it between tasks.

    Functions travel to workers by value, and module variables with them; so it hangs
    on a module of its own.
    """
    held = sys.modules.setdefault("popspark_kept", types.ModuleType("popspark_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path under the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_hash(docs: DataFrame) -> Column:
    """XXH64 of all columns that can be hashed."""
    return F.xxhash64(*[docs[f"`{name}`"] for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def fresh_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as no column of taken has."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def hash_unit(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) from the md5 of seed and columns; null counts as the empty string."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
