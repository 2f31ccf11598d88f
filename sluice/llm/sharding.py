"""Contiguous shards of nearly equal bytes by global prefix sums.

Rows are ordered by doc_id (nulls first; ties by text checksum, size and place in the input) with a
range shuffle of narrow rows, written with their partition number. Totals per partition give every
partition its offset, running sums inside a partition give every row its global position, and a row
belongs to the shard in which the middle of its bytes falls. Two neighbouring cuts are therefore off
by half a document each at most. Defined results: a null text has no bytes and checksum 0; rows that
repeat are placed one after the other; an empty table has no shards; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import utf8
from sluice.session import written

SHARDS = 40
OVERHEAD = 16


def shards(docs: DataFrame, count: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot in the shard (gapless from 0), grown_shard (null by this law)."""
    sized = docs.select("doc_id", (F.octet_length(utf8()).cast("long") + overhead).alias("size"), F.crc32(utf8()).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size", "place"]
    ranged = sized.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order)
    rows = written(ranged.withColumn("part", F.spark_partition_id()), "shards")
    # One row per partition of the range shuffle: small, and the only rows that meet in one task.
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(offsets, "part")
    )
    numbered = placed.select(
        "doc_id", "size", "text_crc32",
        F.expr(f"((2 * (bytes_before + upto) - size) * {count}L) div (2 * all_bytes)").cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
    )
    starts = numbered.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return numbered.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
