"""The event log as a stream: tail, daily budget and idempotent apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "run_id string, seq bigint, ts timestamp, stage string, status string, message string, elapsed_ms bigint, detail string"


def tail(spark: SparkSession, folder: str, after: int = 0) -> DataFrame:
    """Stored events with a higher sequence number, then new ones as they are appended."""
    return spark.readStream.schema(EVENT_SCHEMA).json(folder).filter(F.col("seq") > after)


def daily_calls(calls: DataFrame, ts: str, cap: int, lateness: str = "1 hour") -> DataFrame:
    """Calls per UTC day against a cap. State is one row per open day; late calls beyond the watermark are dropped."""
    n = F.count("*")
    return (
        calls.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day")).agg(n.alias("calls"))
        .select(
            F.to_date("window.start").alias("day"), F.least("calls", F.lit(cap)).alias("calls_used"),
            F.greatest(F.col("calls") - cap, F.lit(0)).alias("refused"),
        )
    )


def apply_once(requests: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """Each idempotency key goes through once within the watermark."""
    return requests.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
