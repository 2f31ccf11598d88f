"""Contract rules for one cell as Spark columns. Every predicate is never null."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sluice.contract import FieldRule
from sluice.functions import dates, patterns
from sluice.functions.text import is_blank

DATE_LABELS_DECIDED = tuple(label for label in patterns.DATE_LABELS if label != patterns.SLASH_AMBIGUOUS)


def no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def as_number(value: Column) -> Column:
    """Numeric view of dirty text; guarded because a plain cast also takes '12d' or ' 1 '."""
    numeric = patterns.whole(value, patterns.DECIMAL_RX) | value.rlike(r"^[+-]?(?i:inf|infinity|nan)\z")
    return F.when(numeric, value.try_cast("double"))


def conforms_type(value: Column, rule: FieldRule, slash_label: str | None = None) -> Column:
    """Does the cell have the declared type? ``slash_label`` is the column-wide day/month decision."""
    if rule.type == "integer":
        return yes(patterns.whole(value, patterns.DIGITS_RX))
    if rule.type == "number":
        return yes(patterns.whole(value, patterns.DECIMAL_RX))
    if rule.type == "boolean":
        return yes(patterns.is_boolean(value))
    if rule.type == "date":
        if rule.format is not None:
            return yes(dates.parses(value, rule.format, datetime=False))
        label = patterns.shape_label(value)
        decided = label.isin(*DATE_LABELS_DECIDED)
        if slash_label in DATE_LABELS_DECIDED:
            decided = decided | (label == patterns.SLASH_UNDECIDED)
        return yes(decided)
    if rule.type == "datetime":
        if rule.format is not None:
            return yes(dates.parses(value, rule.format, datetime=True))
        return yes(patterns.whole(value, patterns.ISO_DATETIME_RX))
    return F.lit(True)


def matched_format(value: Column, rule: FieldRule, slash_label: str | None = None) -> Column:
    """First accepted format that parses a cell the target format refuses; null otherwise."""
    if not rule.accept_formats:
        return F.lit(None).cast("string")
    chain = F.when(conforms_type(value, rule, slash_label), F.lit(None).cast("string"))
    for fmt in rule.accept_formats:
        chain = chain.when(dates.parses(value, fmt, datetime=rule.type == "datetime"), fmt)
    return chain


def regex_violated(value: Column, pattern: str) -> Column:
    if not runs_in_jvm(pattern):
        return ~python_fullmatch(pattern)(value)
    return no(value.rlike(rf"(?U)^(?:{pattern})\z"))


@cache
def runs_in_jvm(pattern: str) -> bool:
    """Does the engine's own compiler take the pattern, in the sense it has in a contract? ``\\Z`` means something else there."""
    if re.search(r"\\Z", pattern):
        return False
    compiler = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern
    try:
        compiler.compile(rf"(?U)^(?:{pattern})\z")
    except IllegalArgumentException:
        return False
    return True


def python_fullmatch(pattern: str):  # noqa: ANN201 - a pandas UDF
    """For patterns that the engine refuses; every distinct value of a batch is matched once."""
    compiled = re.compile(pattern)

    @F.pandas_udf(BooleanType())
    def matches(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)  # null has code -1, the last entry
        fits = np.array([*(compiled.fullmatch(v) is not None for v in distinct), False])
        return pd.Series(fits[codes])

    return matches


def violations(value: Column, rule: FieldRule) -> dict[str, Column]:
    """Limit violations per kind for a non-blank cell; the type check is separate."""
    out: dict[str, Column] = {}
    if rule.min is not None or rule.max is not None:
        number = as_number(value)
        bad = number.isNull()
        if rule.min is not None:
            bad = bad | yes(number < float(rule.min))
        if rule.max is not None:
            bad = bad | yes(number > float(rule.max))
        out["range"] = bad
    if rule.max_length is not None:
        out["max_length"] = yes(F.char_length(value) > rule.max_length)
    if rule.pattern is not None:
        out["pattern"] = regex_violated(value, rule.pattern)
    return out


def valid(value: Column, rule: FieldRule, slash_label: str | None = None) -> Column:
    """All declared limits and the type hold; accepted alternate formats do not count."""
    ok = ~is_blank(value) & conforms_type(value, rule, slash_label)
    for bad in violations(value, rule).values():
        ok = ok & ~bad
    return ok


def within(value: Column, terms: list[str]) -> Column:
    return yes(value.isin(*terms)) if terms else F.lit(False)
