"""Small files that are there whole or not at all, on any file system that Hadoop names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as that one has it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """The text as a file of that name, unless there is one (false). It is written beside it and renamed without overwriting."""
    fs, _ = file_system(spark, path)
    gateway = spark.sparkContext._gateway
    hadoop = gateway.jvm.org.apache.hadoop.fs
    here, there = (fs.makeQualified(hadoop.Path(p)) for p in (f"{path}.{uuid.uuid4().hex}", path))
    out = fs.create(here, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = hadoop.FileContext.getFileContext(here.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(here, there, options)
    except Exception:
        fs.delete(here, False)
        if fs.exists(there):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
