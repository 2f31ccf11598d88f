"""Completeness, validity, consistency, uniqueness and the weighted score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.functions import predicates
from sluice.functions.text import is_blank
from sluice.operators.detect import Knowledge

METRICS = ("completeness", "validity", "consistency", "uniqueness")


def total(parts: list[Column]) -> Column:
    """Sum over rows of a per-row cell count; 0 without any part."""
    per_row = reduce(lambda a, b: a + b, [p.cast("bigint") for p in parts], F.lit(0).cast("bigint"))
    return F.coalesce(F.sum(per_row), F.lit(0).cast("bigint"))


def metric_sums(df: DataFrame, contract: Contract, known: Knowledge) -> DataFrame:
    """One row of numerators and denominators from one pass over the rows, without a shuffle of rows."""

    def filled(name: str) -> Column:
        return ~is_blank(F.col(f"`{name}`"))

    rules = {c: contract.fields[c] for c in known.columns if c in contract.fields}
    required = [c for c, rule in rules.items() if rule.required]
    constrained = [c for c, rule in rules.items() if rule.has_validity]
    listed = [c for c in contract.vocabulary_columns if c in rules]
    return df.agg(
        F.count("*").alias("row_count"),
        total([filled(c) for c in required]).alias("completeness_num"),
        (F.count("*") * len(required)).alias("completeness_den"),
        total([predicates.valid(F.col(f"`{c}`"), rules[c], known.slash.get(c)) for c in constrained]).alias("validity_num"),
        total([filled(c) for c in constrained]).alias("validity_den"),
        total([filled(c) & predicates.within(F.col(f"`{c}`"), rules[c].vocabulary) for c in listed]).alias("consistency_num"),
        total([filled(c) for c in listed]).alias("consistency_den"),
    )


def observed_sums(facts: DataFrame) -> DataFrame:
    """The same row from a profile, for a table without a contract."""
    typed = ~F.col("inferred_type").isin("string", "empty")
    zero = F.lit(0).cast("bigint")
    return facts.agg(
        F.coalesce(F.max("row_count"), zero).alias("row_count"),
        F.coalesce(F.sum("non_empty"), zero).alias("completeness_num"),
        F.coalesce(F.sum("row_count"), zero).alias("completeness_den"),
        F.coalesce(F.sum(F.when(typed, F.col("type_match"))), zero).alias("validity_num"),
        F.coalesce(F.sum(F.when(typed, F.col("non_empty"))), zero).alias("validity_den"),
        zero.alias("consistency_num"),
        zero.alias("consistency_den"),
    )


def metrics(sums: DataFrame, group_totals: DataFrame) -> DataFrame:
    """(metric, numerator, denominator, applicable, score); both inputs have one row."""
    one = F.lit(1).alias("one")
    both = sums.select("*", one).join(group_totals.select("*", one), "one")
    clean = F.greatest(F.col("row_count") - F.col("exact_surplus") - F.col("key_surplus"), F.lit(0))
    pairs = [
        F.struct(
            F.lit(name).alias("metric"),
            (clean if name == "uniqueness" else F.col(f"{name}_num")).cast("bigint").alias("numerator"),
            F.col("row_count" if name == "uniqueness" else f"{name}_den").cast("bigint").alias("denominator"),
        )
        for name in METRICS
    ]
    return both.select(F.inline(F.array(*pairs))).select(
        "metric",
        "numerator",
        "denominator",
        (F.col("denominator") > 0).alias("applicable"),
        F.when(F.col("denominator") > 0, F.round(F.lit(100.0) * F.col("numerator") / F.col("denominator"), 2)).alias("score"),
    )


def overall_score(scored: DataFrame, contract: Contract) -> DataFrame:
    """Weighted mean over the applicable metrics, weights renormalised; null if none applies."""
    pairs = [x for name, w in contract.weights.items() for x in (F.lit(name), F.lit(float(w)))]
    weight = F.try_element_at(F.create_map(*pairs), F.col("metric"))
    counted = F.when(F.col("applicable") & F.col("score").isNotNull(), weight)
    total_weight = F.sum(counted)
    return scored.agg(
        F.when(total_weight > 0, F.round(F.sum(F.col("score") * counted) / total_weight, 2)).alias("overall_score")
    )
