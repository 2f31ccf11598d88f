"""Record identity, row digests and order-free fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE_CHARS = 8  # 32-bit lanes: a bigint sum stays exact for two billion rows per bucket
BUCKET_CHARS = 3  # 4 096 buckets


def record_uid(dataset_hash: Column | str, ordinal: Column) -> Column:
    prefix = F.lit(dataset_hash) if isinstance(dataset_hash, str) else dataset_hash
    text = F.concat(prefix, F.lit(":"), ordinal.cast("string"))
    return F.substring(F.sha2(text, 256), 1, 24)


def encoded(columns: list[str]) -> Column:
    """Length-prefixed join of the cells: null differs from '' and no two rows collide.

    One expression for all cells: spelled out per column it makes methods that the virtual machine doesn't compile.
    """
    cells = F.array(*[F.col(f"`{name}`").cast("string") for name in columns])
    spelled = F.transform(cells, lambda cell: F.coalesce(F.concat(F.char_length(cell).cast("string"), F.lit(":"), cell), F.lit("-")))
    return F.array_join(spelled, "|")


def row_digest(columns: list[str]) -> Column:
    return F.sha2(encoded(columns), 256)


def fingerprint(df: DataFrame, digest: str, by: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a set of hex digests (at least 24 characters each).

    Per bucket the digests are added up in three exact 32-bit lanes, so state is constant and
    partial aggregation absorbs any skew; then at most 4 096 bucket lines are hashed in order.
    """
    return sealed_sums(bucket_sums(df, digest, by), by)


def bucket_sums(df: DataFrame, digest: str, by: list[str] | None = None) -> DataFrame:
    """Counts and lane sums per bucket: those of several parts add up to those of their union."""
    hex_text = F.col(digest)

    def lane(index: int) -> Column:
        piece = F.substring(hex_text, 1 + index * LANE_CHARS, LANE_CHARS)
        return F.sum(F.conv(piece, 16, 10).cast("bigint"))

    return df.groupBy(*(by or []), F.substring(hex_text, 1, BUCKET_CHARS).alias("bucket")).agg(
        F.count("*").alias("n"), lane(0).alias("l0"), lane(1).alias("l1"), lane(2).alias("l2")
    )


def sealed_sums(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    buckets = sums.withColumn("line", F.concat_ws(":", "bucket", "n", "l0", "l1", "l2"))
    lines = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return buckets.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.sha2(lines, 256).alias("fingerprint")
    )


def canonical_number(value: Column) -> Column:
    """Round to 8 places; non-finite becomes null."""
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, F.round(value, 8))


def json_hash(value: Column) -> Column:
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)
