"""Unlisted category values: candidates, external proposals, and the normalized-match fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.functions.patterns import looks_sensitive
from sluice.functions.text import is_blank, normalize_text
from sluice.operators.profile import cells

CANDIDATE_LIMIT = 30
CANDIDATE_CHARS = 64


def unlisted_counts(df: DataFrame, contract: Contract, withheld: list[str]) -> DataFrame:
    """(column, value, cnt) of harmless short values outside vocabulary and registry.

    The filters run before the shuffle, so only unlisted values travel.
    """
    columns = [c for c in contract.named("semantic") if c in df.columns and c not in withheld]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, cnt bigint")
    listed = F.lit(False)
    for column in columns:
        terms = [*contract.fields[column].vocabulary, *contract.tokens(column)]
        if terms:
            listed = listed | ((F.col("column") == column) & F.col("value").isin(*terms))
    value = F.col("value")
    return (
        cells(df, columns)
        .filter(~is_blank(value) & ~listed & (F.char_length(value) <= CANDIDATE_CHARS))
        .groupBy("column", "value")
        .agg(F.count("*").alias("cnt"))
        .filter(~looks_sensitive(value))
    )


def candidates(counts: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """The most frequent candidates per column; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("value"))
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("column", "value", "cnt", "rank")
    )


def truncated(counts: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    return counts.groupBy("column").agg(F.count("*").alias("total")).select(
        "column", "total", (F.col("total") > limit).alias("truncated")
    )


def normalized_match(found: DataFrame, vocab: DataFrame, ambiguity: DataFrame) -> DataFrame:
    """(column, source, target): the candidate equals a target or alias after normalization.

    Targets win over aliases, earlier terms over later ones. Both sides are bounded by the
    candidate limit and the contract limits.
    """
    first = Window.partitionBy("column", "norm").orderBy("priority")
    terms = vocab.withColumn("pick", F.row_number().over(first)).filter("pick = 1").select("column", "norm", "target")
    folded = found if "norm" in found.columns else found.withColumn("norm", normalize_text("value"))
    return (
        folded.join(terms, ["column", "norm"])
        .filter(F.col("target") != F.col("value"))
        .join(ambiguity, ["column", "value"], "left_anti")
        .select("column", F.col("value").alias("source"), "target")
    )


def usable_proposals(proposals: DataFrame, found: DataFrame, vocab: DataFrame, ambiguity: DataFrame) -> DataFrame:
    """Grounded, non-abstaining external mappings restricted to candidates and vocabulary.

    ``proposals``: (column, source, target, grounded, abstained).
    """
    listed = vocab.select("column", F.col("value").alias("target")).distinct()
    seen = found.select("column", F.col("value").alias("source"))
    return (
        proposals.filter("grounded AND NOT abstained")
        .filter(F.col("source") != F.col("target"))
        .join(seen, ["column", "source"], "left_semi")
        .join(listed, ["column", "target"], "left_semi")
        .join(ambiguity.withColumnRenamed("value", "source"), ["column", "source"], "left_anti")
        .select("column", "source", "target")
    )


def resolve(found: DataFrame, vocab: DataFrame, ambiguity: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """Mapping per column: the usable proposal where there is one, else the normalized match."""
    fallback = normalized_match(found, vocab, ambiguity).withColumn("resolver", F.lit("deterministic"))
    if proposals is None:
        return fallback
    external = usable_proposals(proposals, found, vocab, ambiguity).withColumn("resolver", F.lit("external"))
    rest = fallback.join(external.select("column").distinct(), "column", "left_anti")
    return external.unionByName(rest)


def totals(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records behind all, mapped and unmapped candidates per column."""
    mapped = mapping.select("column", F.col("source").alias("value"), F.lit(True).alias("mapped"))
    is_mapped = F.col("mapped").isNotNull()
    return found.join(mapped, ["column", "value"], "left").groupBy("column").agg(
        F.sum("cnt").alias("candidate_records"),
        F.sum(F.when(is_mapped, F.col("cnt"))).alias("mapped_records"),
        F.sum(F.when(~is_mapped, F.col("cnt"))).alias("unmapped_records"),
    )
