"""Mergeable summaries of columns: kept per run, merged over runs, exact counts never needed again.

A run's summary is one row per column with a distinct-count sketch of its filled cells and the exact numbers
that simply add up. Summaries of any runs merge to that of all their rows; a value in two runs counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import is_blank
from sluice.operators.profile import cells

LOG_BUCKETS = 12
# Standard error 1.04 / sqrt(2^12); an estimate is within three of them in all but some 0.3 % of columns.
RELATIVE_BOUND = 3 * 1.04 / 2 ** (LOG_BUCKETS / 2)


def summaries(df: DataFrame, columns: list[str], run: str | None = None) -> DataFrame:
    """(run, column, cells, filled, distinct_sketch) of every run, named by the column ``run``; one run without it."""
    by = [F.col(f"`{run}`").alias("run")] if run else [F.lit("").alias("run")]
    tagged = df.select(*by, *[F.col(f"`{c}`") for c in columns]).unpivot(["run"], columns, "column", "value")
    filled = F.when(~is_blank(F.col("value")), F.col("value"))
    return tagged.groupBy("run", "column").agg(
        F.count("*").alias("cells"), F.count(filled).alias("filled"), F.hll_sketch_agg(filled, LOG_BUCKETS).alias("distinct_sketch")
    )


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summaries of several runs as one, per ``by`` (default: per column)."""
    return parts.groupBy(*(by or ["column"])).agg(
        F.sum("cells").alias("cells"), F.sum("filled").alias("filled"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch")
    )


def estimates(summary: DataFrame) -> DataFrame:
    """The estimated distinct count of each summary with the bound on its error."""
    estimate = F.hll_sketch_estimate("distinct_sketch")
    return summary.withColumn("estimate", estimate).withColumn("bound", F.greatest(F.lit(1.0), F.ceil(estimate * RELATIVE_BOUND).cast("double"))).drop("distinct_sketch")


def compared(df: DataFrame, columns: list[str], summary: DataFrame) -> DataFrame:
    """The estimates next to the exact counts of ``df``."""
    value = F.col("value")
    exact = cells(df, columns).filter(~is_blank(value)).groupBy("column").agg(F.count_distinct("value").alias("exact"))
    joined = estimates(summary).join(exact, "column", "left").withColumn("exact", F.coalesce("exact", F.lit(0)))
    return joined.withColumn("within", F.abs(F.col("estimate") - F.col("exact")) <= F.col("bound"))
