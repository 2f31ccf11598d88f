"""Text predicates and clean-up as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
CONTROL_CHARS = r"[\x00-\x1f\x7f-\x9f\u200b-\u200f\u2028\u2029\ufeff]"
MAX_VALUE_CHARS = 64


def strip_text(value: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (plain ``trim`` keeps tab and U+3000)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    """Null or whitespace only; never null itself. A text that begins with a visible ASCII character needs no pattern."""
    return F.coalesce(~(value.between("!", "~") | value.rlike(r"(?U)\S")), F.lit(True))


def sanitize(value: Column, limit: int = MAX_VALUE_CHARS) -> Column:
    return F.substring(F.regexp_replace(value, CONTROL_CHARS, ""), 1, limit)


def fold_text(value: str) -> str:
    compact = unicodedata.normalize("NFKC", value).casefold().strip()
    return re.sub(r"\s+", " ", compact)


@F.pandas_udf(StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """NFKC, case folding and whitespace collapsing. Spark has no NFKC, so this one is Python;
    it is only ever applied to candidate and vocabulary terms, never to rows."""
    return values.map(fold_text, na_action="ignore")
