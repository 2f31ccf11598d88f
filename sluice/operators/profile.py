"""Column profiling: one unpivot, one shuffle on (column, cell), then small aggregates.

Where a profile needs only counts, long texts travel as a digest with the first characters of the text.
Everything else the profile needs from a long text (its shape, class and length) is worked out
before the shuffle, so a column of 20 000-word documents shuffles some 200 bytes per row instead of
the documents. What is published is always the whole text: ``value_counts`` groups the texts themselves,
``top_values`` fetches the texts of the cells that can still be among the first and ranks by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.functions import dates, patterns
from sluice.functions.predicates import as_number
from sluice.functions.text import is_blank
from sluice.session import written

LONG_CHARS = 128
TOP_VALUES = 5

# Families in the order in which a column's dates are parsed.
FAMILIES = {
    "ymd_dash": patterns.YMD_DASH,
    "ymd_slash": patterns.YMD_SLASH,
    "dmy": patterns.DMY_SLASH,
    "mdy": patterns.MDY_SLASH,
    "compact": patterns.YMD_COMPACT,
}
RAW_LABELS = (
    patterns.ISO_DATETIME, patterns.YMD_DASH, patterns.YMD_SLASH, patterns.SLASH_UNDECIDED,
    patterns.YMD_COMPACT, patterns.DIGITS, patterns.DECIMAL, patterns.BOOLEAN, patterns.TEXT,
    patterns.MIXED,
)

FINAL_LABELS = (*[label for label in RAW_LABELS if label != patterns.SLASH_UNDECIDED], *patterns.DATE_LABELS[2:5])


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows to (column, value)."""
    return df.select(*[F.col(f"`{c}`") for c in columns]).unpivot([], columns, "column", "value")


def is_long(value: Column) -> Column:
    """Long and certainly not a number, so the original text is never needed for min or max."""
    return F.coalesce(
        (F.char_length(value) > LONG_CHARS) & value.rlike("[^0-9+.eE-]"), F.lit(False)
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt, blank, pattern, pattern_class, chars), one row per distinct cell with its whole text."""
    value = F.col("value")
    return cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("cnt")).select(
        "column",
        "value",
        "cnt",
        is_blank(value).alias("blank"),
        patterns.shape_label(value).alias("pattern"),
        patterns.sensitive_class(value).alias("pattern_class"),
        F.char_length(value).alias("chars"),
    )


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``value_counts`` for further aggregation: also (is_long, head), and a narrow shuffle.

    ``value`` is the digest of the text where ``is_long``. ``head`` orders the cells as their texts
    do, but for ties of long texts: the text itself, of long ones the first characters. Blank cells
    keep their own rows.
    """
    return weighted_counts(cells(df, columns).withColumn("weight", F.lit(1)))


def moved_counts(counts: DataFrame, moves: DataFrame) -> DataFrame:
    """``cell_counts`` after cells changed: ``moves`` (column, value, weight) takes values away and adds others.

    Neither the table before nor the one after is read.
    """
    names = [c for c in counts.columns if c != "cnt"]
    together = counts.unionByName(weighted_counts(moves))
    return together.groupBy(*names).agg(F.sum("cnt").alias("cnt")).filter("cnt <> 0").select(*counts.columns)


def weighted_counts(weighed: DataFrame) -> DataFrame:
    """Counts as sums of ``weight`` over (column, value, weight)."""
    value, long = F.col("value"), F.col("long")
    # Head, shape, class and length follow from a long text, so as an extra key they change no group and
    # leave a plain sum, which Spark aggregates by hash without sorting. One key for them all keeps the
    # hash table's rows short where no text is long.
    told = F.struct(
        F.substring(value, 1, LONG_CHARS).alias("head"), patterns.shape_label(value).alias("pattern"),
        patterns.sensitive_class(value).alias("class"), F.char_length(value).alias("chars"), is_blank(value).alias("blank"),
    )
    keyed = weighed.withColumn("is_long", is_long(value)).select(
        "column", F.when(F.col("is_long"), F.sha2(value, 256)).otherwise(value).alias("value"), F.when(F.col("is_long"), told).alias("long"), "weight"
    )
    counted = keyed.groupBy("column", "value", "long").agg(F.sum("weight").alias("cnt")).withColumn("is_long", long.isNotNull())
    return counted.select(
        "column",
        "value",
        "is_long",
        F.when(F.col("is_long"), long["head"]).otherwise(value).alias("head"),
        "cnt",
        F.when(F.col("is_long"), long["blank"]).otherwise(is_blank(value)).alias("blank"),
        F.when(F.col("is_long"), long["pattern"]).otherwise(patterns.shape_label(value)).alias("pattern"),
        F.when(F.col("is_long"), long["class"]).otherwise(patterns.sensitive_class(value)).alias("pattern_class"),
        F.when(F.col("is_long"), long["chars"]).otherwise(F.char_length(value)).alias("chars"),
    )


def slash_decision(first: Column, second: Column) -> dict[str, Column]:
    """Evidence about a column's two-digit slash dates, as aggregates."""
    return {
        "day_first": F.bool_or(first > 12),
        "month_first": F.bool_or(second > 12),
        "first_day": F.bool_and(first.between(1, 31)),
        "second_month": F.bool_and(second.between(1, 12)),
        "first_month": F.bool_and(first.between(1, 12)),
        "second_day": F.bool_and(second.between(1, 31)),
    }


def slash_label(prefix: str = "") -> Column:
    """Column-wide label from the evidence columns above; null without any slash date."""

    def seen(name: str) -> Column:
        return F.col(prefix + name)

    dmy_fits = seen("first_day") & seen("second_month")
    mdy_fits = seen("first_month") & seen("second_day")
    return (
        F.when(seen("day_first").isNull(), F.lit(None).cast("string"))
        .when(seen("day_first") & ~seen("month_first") & dmy_fits, patterns.DMY_SLASH)
        .when(seen("month_first") & ~seen("day_first") & mdy_fits, patterns.MDY_SLASH)
        .when(dmy_fits & mdy_fits, patterns.SLASH_AMBIGUOUS)
        .otherwise(patterns.MIXED)
    )


def slash_evidence(value: Column, undecided: Column) -> dict[str, Column]:
    first = F.when(undecided, F.substring(value, 1, 2).try_cast("int"))
    second = F.when(undecided, F.substring(value, 4, 2).try_cast("int"))
    return slash_decision(first, second)


def column_facts(counts: DataFrame) -> DataFrame:
    """One row per column: counts, shape counts, type vote, typed min and max, sensitive hits.

    Three aggregates: by shape and class on fixed-width values only (hash aggregation), a second
    one over those few rows, and the texts of the extreme values.
    """
    value = F.col("value")
    filled = ~F.col("blank")
    datelike = filled & ~F.col("is_long") & value.rlike(r"(?U)^\d{1,4}[-/]?\d{1,2}[-/]?\d{1,4}$")
    parsed = {
        family: F.when(datelike, dates.parse_date(value, patterns.LABEL_FORMATS[label]))
        for family, label in FAMILIES.items()
    }
    undecided = filled & (F.col("pattern") == patterns.SLASH_UNDECIDED)
    by_shape = counts.groupBy("column", "blank", "pattern", "pattern_class").agg(
        F.sum("cnt").alias("cells"),
        F.count("*").alias("values"),
        F.max("chars").alias("chars"),
        *[F.min(date).alias(f"lo_{family}") for family, date in parsed.items()],
        *[F.max(date).alias(f"hi_{family}") for family, date in parsed.items()],
        *[agg.alias(name) for name, agg in slash_evidence(value, undecided).items()],
    )
    facts = by_shape.groupBy("column").agg(*[agg.alias(n) for n, agg in shape_totals().items()])
    facts = facts.join(F.broadcast(extreme_texts(counts)), "column", "left")
    facts = facts.select("*", slash_label().alias("slash_label"))
    facts = facts.select("*", *[settled(label).alias(f"c_{label}") for label in FINAL_LABELS])
    return with_type(facts).select(
        "column", "row_count", "empty", "non_empty", "distinct_count", "max_length",
        "inferred_type", "type_match", "min_value", "max_value", "sensitive_hits", "slash_label",
        shape_map().alias("shapes"), *[f"hits_{c}" for c in patterns.SENSITIVE_CLASSES],
    )


def shape_totals() -> dict[str, Column]:
    """Aggregates from the per-shape rows of a column to its facts."""

    def cells_where(condition: str) -> str:
        return f"coalesce(sum(if({condition}, cells, 0)), 0)"

    sql = {
        "row_count": "sum(cells)",
        "empty": cells_where("blank"),
        "non_empty": cells_where("NOT blank"),
        "distinct_count": "coalesce(sum(if(NOT blank, values, 0)), 0)",
        "max_length": "coalesce(max(if(NOT blank, chars, 0)), 0)",
        "sensitive_hits": cells_where("NOT blank AND pattern_class IS NOT NULL"),
        **{f"n_{label}": cells_where(f"NOT blank AND pattern = '{label}'") for label in RAW_LABELS},
        **{f"hits_{c}": cells_where(f"NOT blank AND pattern_class = '{c}'") for c in patterns.SENSITIVE_CLASSES},
        **{f"lo_{family}": f"min(lo_{family})" for family in FAMILIES},
        **{f"hi_{family}": f"max(hi_{family})" for family in FAMILIES},
        **{name: f"bool_or({name})" for name in ("day_first", "month_first")},
        **{n: f"bool_and({n})" for n in ("first_day", "second_month", "first_month", "second_day")},
    }
    return {name: F.expr(text) for name, text in sql.items()}


def extreme_texts(counts: DataFrame) -> DataFrame:
    """Original text of the smallest and largest number and ISO datetime of each column.

    Reads ``counts`` a second time, so callers write the counts once first.

    Equal numbers are told apart by frequency, then text. The observed shapes are collected
    alongside, which lets Spark keep these text buffers in a hash map instead of sorting.
    """
    value, cnt = F.col("value"), F.col("cnt")
    numeric_like = F.col("pattern").isin(patterns.DIGITS, patterns.DECIMAL, patterns.YMD_COMPACT, patterns.MIXED)
    dated = F.col("pattern").isin(patterns.YMD_DASH, patterns.YMD_SLASH, patterns.ISO_DATETIME)
    usable = counts.filter(
        ~F.col("blank") & ~F.col("is_long") & (numeric_like | dated)
    ).withColumn("number", as_number(value))
    iso = F.when(F.col("pattern") == patterns.ISO_DATETIME, value)
    number = F.col("number")
    return usable.groupBy("column").agg(
        F.collect_set("pattern").alias("observed"),
        F.min(iso).alias("iso_min"),
        F.max(iso).alias("iso_max"),
        F.min_by(value, F.when(number.isNotNull(), F.struct(number, -cnt, value))).alias("num_min"),
        F.min_by(value, F.when(number.isNotNull(), F.struct(-number, -cnt, value))).alias("num_max"),
    )


def settled(label: str) -> Column:
    """Cells of a final shape: its own and, where the column decided so, the slash dates."""
    own = f"`n_{label}`" if label in RAW_LABELS else "0"
    if label in (patterns.DMY_SLASH, patterns.MDY_SLASH, patterns.SLASH_AMBIGUOUS, patterns.MIXED):
        own += f" + if(slash_label <=> '{label}', `n_{patterns.SLASH_UNDECIDED}`, 0)"
    return F.expr(own)


def shape_map() -> Column:
    pairs = ", ".join(f"'{label}', `c_{label}`" for label in FINAL_LABELS)
    return F.expr(f"map_filter(map({pairs}), (label, cells) -> cells > 0)")


def with_type(facts: DataFrame) -> DataFrame:
    """The 98 % vote, and the minimum and maximum of the winning type."""
    votes = {
        "datetime": f"`c_{patterns.ISO_DATETIME}`",
        "date": " + ".join(f"`c_{label}`" for label in patterns.DATE_LABELS),
        "integer": f"`c_{patterns.DIGITS}`",
        "number": f"`c_{patterns.DIGITS}` + `c_{patterns.DECIMAL}`",
        "boolean": f"`c_{patterns.BOOLEAN}`",
    }
    bar = f"{patterns.TYPE_THRESHOLD}D * non_empty"
    kind = " ".join(f"WHEN {tally} >= {bar} THEN '{name}'" for name, tally in votes.items())
    match = " ".join(f"WHEN {tally} >= {bar} THEN {tally}" for tally in votes.values())
    facts = facts.select(
        "*",
        F.expr(f"CASE WHEN non_empty = 0 THEN 'empty' {kind} ELSE 'string' END").alias("inferred_type"),
        F.expr(f"CASE WHEN non_empty = 0 THEN 0 {match} ELSE non_empty END").alias("type_match"),
    )
    # A column without any unambiguous date family is read as ISO dates.
    fixed = ", ".join(f"'{label}'" for label in (patterns.YMD_DASH, patterns.YMD_SLASH, patterns.YMD_COMPACT))
    none_seen = (
        f"size(array_intersect(observed, array({fixed}))) <= 0 "
        f"AND `c_{patterns.DMY_SLASH}` + `c_{patterns.MDY_SLASH}` = 0"
    )

    def edge(side: str, name: str, pick: str) -> Column:
        ends = ", ".join(
            f"if(`c_{label}` > 0{f' OR ({none_seen})' if family == 'ymd_dash' else ''}, {side}_{family}, NULL)"
            for family, label in FAMILIES.items()
        )
        return F.expr(
            f"CASE WHEN inferred_type IN ('integer', 'number') THEN num_{name} "
            f"WHEN inferred_type = 'date' THEN date_format({pick}({ends}), 'yyyy-MM-dd') "
            f"WHEN inferred_type = 'datetime' THEN iso_{name} END"
        ).alias(f"{name}_value")

    return facts.select("*", edge("lo", "min", "least"), edge("hi", "max", "greatest"))


def top_values(df: DataFrame, counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """(column, rank, value, cnt, pattern_class): the most frequent cells per column, equal counts by text.

    ``counts`` are the ``cell_counts`` of ``df``. A cell behind k others by count and head is behind
    them by count and text too, so ranking by heads leaves every cell that can be among the first;
    Spark pushes that limit below the shuffle. Only of those left are the long texts read again.
    """
    by_head = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("head"))
    near = counts.filter(~F.col("blank")).withColumn("place", F.rank().over(by_head)).filter(F.col("place") <= k)
    near = written(near.select("column", "value", "is_long", "cnt", "pattern_class"), "top")
    by_text = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("value"))
    return (
        with_texts(df, near)
        .withColumn("rank", F.row_number().over(by_text))
        .filter(F.col("rank") <= k)
        .select("column", "rank", "value", "cnt", "pattern_class")
    )


def with_texts(df: DataFrame, near: DataFrame) -> DataFrame:
    """``near`` with texts for digests. ``near`` is written, so Spark knows its bytes when it picks the join."""
    long = near.filter("is_long").select("column", "value")
    columns = [row["column"] for row in long.select("column").distinct().collect()]  # bounded by the columns
    if not columns:
        return near
    texts = cells(df, columns).filter(is_long(F.col("value"))).select("column", F.sha2("value", 256).alias("value"), F.col("value").alias("text"))
    found = texts.join(long, ["column", "value"]).dropDuplicates(["column", "value"])
    return near.join(found, ["column", "value"], "left").withColumn("value", F.coalesce("text", "value"))


def pattern_histogram(facts: DataFrame) -> DataFrame:
    return facts.select("column", F.explode("shapes").alias("pattern", "cells"))


def sensitive_hits(facts: DataFrame) -> DataFrame:
    """(column, pattern_class, cells) for classes that occur."""
    classes = F.array(
        *[F.struct(F.lit(c).alias("pattern_class"), F.col(f"hits_{c}").alias("cells")) for c in patterns.SENSITIVE_CLASSES]
    )
    return facts.select("column", F.inline(classes)).filter("cells > 0")


def withheld_columns(facts: DataFrame, contract: Contract) -> DataFrame:
    """Declared sensitive columns together with columns that have hits."""
    declared = contract.named("sensitive")
    is_declared = F.col("column").isin(*declared) if declared else F.lit(False)
    return facts.filter(is_declared | (F.col("sensitive_hits") > 0)).select("column")


def column_profile(df: DataFrame, counts: DataFrame, facts: DataFrame, contract: Contract) -> DataFrame:
    """The published profile: values are masked in withheld columns and wherever they look sensitive."""
    withheld = withheld_columns(facts, contract).withColumn("withheld", F.lit(True))
    marked = facts.join(F.broadcast(withheld), "column", "left").withColumn(
        "withheld", F.coalesce("withheld", F.lit(False))
    )
    top = top_values(df, counts).join(F.broadcast(marked.select("column", "withheld")), "column")
    hidden = F.col("withheld") | F.col("pattern_class").isNotNull()
    shown = top.select(
        "column",
        "rank",
        F.when(hidden, patterns.mask_for(F.col("pattern_class"))).otherwise(F.col("value")).alias("value"),
        F.col("cnt").alias("count"),
        F.when(hidden, F.coalesce("pattern_class", F.lit("text"))).alias("pattern_class"),
    )
    per_column = shown.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count", "pattern_class"))).alias("top_values")
    )
    flags = F.create_map(
        *[F.lit(x) for name, rule in contract.fields.items() for x in (name, ",".join(rule.flags()))]
    ) if contract.fields else F.create_map(F.lit(""), F.lit(""))
    return marked.join(F.broadcast(per_column), "column", "left").select(
        "column",
        "inferred_type",
        F.col("empty").alias("null_count"),
        F.when(F.col("row_count") > 0, F.round(F.col("empty") / F.col("row_count"), 6)).otherwise(0.0).alias("null_rate"),
        "distinct_count",
        "top_values",
        F.when(~F.col("withheld"), F.col("min_value")).alias("min_value"),
        F.when(~F.col("withheld"), F.col("max_value")).alias("max_value"),
        "max_length",
        F.map_entries("shapes").alias("format_patterns"),
        F.col("sensitive_hits").alias("sensitive_hit_count"),
        F.try_element_at(flags, F.col("column")).alias("contract_flags"),
        "withheld",
    )
