"""Small files and renames in any store Spark writes to, through the session's own file systems."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The store's file system and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = located(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    system, at = located(spark, path)
    system.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, at = located(spark, path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", "true").text(path).first()[0]


def move(spark: SparkSession, source: str, target: str, *, replace: bool = False) -> None:
    """Rename in one step; a reader sees the old target or the new one, never half of it."""
    system, at = located(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, int(replace))
    if replace:
        how[0] = kinds.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(at, to, how)
