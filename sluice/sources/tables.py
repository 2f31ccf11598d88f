"""Typed tables as all-text tables with fixed formats, and record identity on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.hashing import record_uid

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table with fewer splits than cores; larger tables are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_text(field: T.StructField, decimals: int) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        return column.cast(T.DecimalType(38, decimals)).cast("string")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, TIMESTAMP_FORMAT)
    if isinstance(field.dataType, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def stringify(df: DataFrame, *, keep: list[str] | None = None, decimals: int = 2) -> DataFrame:
    """Every column as text, with ``decimals`` places for fractions; ``keep`` stays typed."""
    keep = keep or []
    return df.select(
        *[
            F.col(f"`{f.name}`") if f.name in keep else as_text(f, decimals).alias(f.name)
            for f in df.schema.fields
        ]
    )


def with_identity(df: DataFrame, dataset_hash: str, ordinal: str | Column) -> DataFrame:
    """Add ``ordinal`` and ``record_uid`` in front, from a unique source key."""
    key = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    number = key.cast("bigint")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("ordinal", "record_uid")]
    return df.select(number.alias("ordinal"), record_uid(dataset_hash, number).alias("record_uid"), *rest)
