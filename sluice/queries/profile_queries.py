"""Profiles of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.contract import Contract, FieldRule
from sluice.functions import patterns, predicates
from sluice.operators import ground, groups, profile, sketches
from sluice.queries import feeds, sqltext
from sluice.queries.sqltext import facts_sql
from sluice.session import written
from sluice.sources.tables import read_table, stringify

PROFILED = ("orders", "customer", "part", "lineitem", "events", "documents", "pages", "conversations")
QUERIES = {}
ORACLES = {}


def text_table(spark, folder, name):
    return stringify(read_table(spark, folder, name))


def counted(spark, folder, name):
    df = text_table(spark, folder, name)
    return written(profile.cell_counts(df, df.columns), "counts")


def query(name, sql):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# -- value counts and what follows from them -------------------------------------------------
def value_counts_query(table):
    def run(spark, folder):
        df = text_table(spark, folder, table)
        return profile.value_counts(df, df.columns).filter("NOT blank").select(
            "column", "value", "cnt", "pattern", "pattern_class"
        )

    sql = (
        f"WITH {sqltext.counts_sql(table)} SELECT col AS \"column\", value, cnt, pattern, "
        "cls AS pattern_class FROM counts WHERE NOT blank"
    )
    query(f"value_counts_{table}", sql)(run)


def top_values_query(table):
    def run(spark, folder):
        df = text_table(spark, folder, table)
        return profile.top_values(df, counted(spark, folder, table)).select(
            "column", F.col("rank").cast("bigint").alias("rank"), "value", "cnt"
        )

    sql = (
        f"WITH {sqltext.counts_sql(table)} SELECT col AS \"column\", rank, value, cnt FROM (SELECT *, "
        "ROW_NUMBER() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank FROM counts WHERE NOT blank) WHERE rank <= 5"
    )
    query(f"top_values_{table}", sql)(run)


def pattern_histogram_query(table):
    def run(spark, folder):
        return profile.pattern_histogram(profile.column_facts(counted(spark, folder, table)))

    query(
        f"pattern_histogram_{table}",
        facts_sql(table) + ' SELECT col AS "column", pattern, cells FROM shapes',
    )(run)


def column_facts_query(table):
    def run(spark, folder):
        facts = profile.column_facts(counted(spark, folder, table))
        return facts.select(
            "column", "row_count", "empty", "non_empty", "distinct_count",
            F.col("max_length").cast("bigint").alias("max_length"),
            "inferred_type", "type_match", "min_value", "max_value", "sensitive_hits",
        )

    query(
        f"column_facts_{table}",
        facts_sql(table)
        + f""" SELECT f.col AS "column", f.row_count, f.empty, f.n AS non_empty, f.distinct_count, f.max_length,
  v.inferred_type, v.type_match, {sqltext.edge('min')} AS min_value, {sqltext.edge('max')} AS max_value, f.sensitive_hits
  FROM filled f JOIN vote v ON v.col = f.col LEFT JOIN edges e ON e.col = f.col""",
    )(run)


for _table in ("orders", "customer", "documents"):
    value_counts_query(_table)
for _table in ("orders", "part", "lineitem", "conversations"):
    top_values_query(_table)
for _table in ("orders", "events", "pages"):
    pattern_histogram_query(_table)
for _table in ("orders", "customer", "part", "lineitem", "events", "documents", "pages", "conversations", "supplier", "labels"):
    column_facts_query(_table)


def feed_counts(spark, folder):
    df = feeds.orders_feed(spark, folder).select(*feeds.ORDER_NAMES)
    return df, written(profile.cell_counts(df, df.columns), "counts")


FEED_FACTS = facts_sql("feed", {name: name for name in feeds.ORDER_NAMES}, feeds.feed_sql())


@query("type_vote_feed", FEED_FACTS + ' SELECT col AS "column", n AS non_empty, inferred_type, type_match FROM vote')
def type_vote_feed(spark, folder):
    facts = profile.column_facts(feed_counts(spark, folder)[1])
    return facts.select("column", "non_empty", "inferred_type", "type_match")


@query("slash_date_decision", FEED_FACTS + ' SELECT col AS "column", slash_label FROM slash')
def slash_date_decision(spark, folder):
    facts = profile.column_facts(feed_counts(spark, folder)[1])
    return facts.filter("slash_label IS NOT NULL").select("column", "slash_label")


@query(
    "typed_min_max_feed",
    FEED_FACTS + f' SELECT v.col AS "column", {sqltext.edge("min")} AS min_value, {sqltext.edge("max")} AS max_value '
    "FROM vote v LEFT JOIN edges e ON e.col = v.col",
)
def typed_min_max_feed(spark, folder):
    return profile.column_facts(feed_counts(spark, folder)[1]).select("column", "min_value", "max_value")


_FORMATS = " ".join(f"WHEN '{label}' THEN '{fmt}'" for label, fmt in patterns.LABEL_FORMATS.items())


@query(
    "observed_formats",
    FEED_FACTS + f""" SELECT col AS "column", CASE pattern {_FORMATS} END AS format, cells,
  ROW_NUMBER() OVER (PARTITION BY col ORDER BY cells DESC, pattern) AS rank
  FROM shapes WHERE pattern IN ({', '.join(repr(x) for x in patterns.LABEL_FORMATS)})""",
)
def observed_formats(spark, folder):
    from sluice.operators.ground import observed_formats as formats

    facts = profile.column_facts(feed_counts(spark, folder)[1])
    return formats(facts).select("column", "format", "cells", F.col("rank").cast("bigint").alias("rank"))


# -- sensitive scans -------------------------------------------------------------------------
OBSERVED_FORMATS = FEED_FACTS + f""", formats AS (SELECT col, CASE pattern {_FORMATS} END AS format,
  ROW_NUMBER() OVER (PARTITION BY col ORDER BY cells DESC, pattern) AS rank FROM shapes WHERE pattern IN ({', '.join(repr(x) for x in patterns.LABEL_FORMATS)}))"""


@query(
    "derived_accept_formats",
    OBSERVED_FORMATS + """, ranked AS (SELECT f.*, FIRST_VALUE(format) OVER (PARTITION BY col ORDER BY rank) AS top FROM formats f)
SELECT r.col AS field, r.top AS format, COALESCE(STRING_AGG(r.format, ',' ORDER BY rank) FILTER (WHERE r.format <> r.top), '') AS accept_formats
FROM ranked r JOIN vote v ON v.col = r.col WHERE v.inferred_type = 'date' GROUP BY r.col, r.top""",
)
def derived_accept_formats(spark, folder):
    """Every column is drafted as a date of its most frequent format: where that is grounded, the other observed formats are accepted too."""
    df = feeds.orders_feed(spark, folder).select(*feeds.ORDER_NAMES)
    counts = feed_counts(spark, folder)[1]
    facts = written(profile.column_facts(counts), "facts")
    formats = ground.observed_formats(facts)
    shown = profile.column_profile(df, counts, facts, Contract())
    top = formats.filter("rank = 1").select(F.col("column").alias("field"), "format")
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(None).cast("string").alias("item"), v.alias("value")) for r, v in (("type", F.lit("date")), ("format", F.col("format")))])
    draft = top.select("field", F.inline(each))
    return ground.derived_formats(draft, shown, ground.observed_values(shown), formats).withColumn("accept_formats", F.array_join("accept_formats", ","))


def sensitive_scan_query(table):
    def run(spark, folder):
        return profile.sensitive_hits(profile.column_facts(counted(spark, folder, table)))

    sql = (
        f"WITH cells AS ({sqltext.cells_sql(table)}) SELECT col AS \"column\", {sqltext.sensitive('v')} AS pattern_class, "
        f"COUNT(*) AS cells FROM cells WHERE {sqltext.sensitive('v')} IS NOT NULL GROUP BY 1, 2"
    )
    query(f"sensitive_scan_{table}", sql)(run)


for _table in ("documents", "pages"):
    sensitive_scan_query(_table)


@query(
    "masked_documents",
    f"SELECT doc_id, {sqltext.mask(sqltext.sensitive('text'))} AS masked, {sqltext.sensitive('text')} AS pattern_class "
    f"FROM documents WHERE {sqltext.sensitive('text')} IS NOT NULL",
)
def masked_documents(spark, folder):
    df = read_table(spark, folder, "documents")
    kind = patterns.sensitive_class(F.col("text"))
    return df.select("doc_id", "text", kind.alias("pattern_class")).filter("pattern_class IS NOT NULL").select(
        "doc_id", patterns.mask_for(F.col("pattern_class")).alias("masked"), "pattern_class"
    )


_HINTS = " OR ".join(f"LOWER(col) LIKE '%{t}%'" for t in patterns.SENSITIVE_NAME_TOKENS)
_ALL_NAMES = " UNION ALL ".join(
    f"SELECT '{table}' AS tbl, col, CAST(SUM(CASE WHEN {sqltext.sensitive('v')} IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits "
    f"FROM ({sqltext.cells_sql(table)}) GROUP BY col"
    for table in ("customer", "documents", "pages")
)


@query(
    "sensitive_columns",
    f"SELECT tbl, col AS \"column\", hits > 0 AS withheld, ({_HINTS}) AS named FROM ({_ALL_NAMES}) WHERE hits > 0 OR ({_HINTS})",
)
def sensitive_columns(spark, folder):
    """Withheld columns, and columns whose name alone suggests personal data."""
    out = None
    for table in ("customer", "documents", "pages"):
        facts = profile.column_facts(counted(spark, folder, table))
        named = [c for c in sqltext.text_columns(table) if patterns.is_sensitive_name(c)]
        hint = F.col("column").isin(*named) if named else F.lit(False)
        part = facts.filter((F.col("sensitive_hits") > 0) | hint).select(
            F.lit(table).alias("tbl"), "column", (F.col("sensitive_hits") > 0).alias("withheld"), hint.alias("named")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "masked_cell_count",
    f"WITH {sqltext.counts_sql('documents')} SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS cells_masked FROM (SELECT SUM(cnt) FILTER (WHERE NOT blank) AS n "
    "FROM counts GROUP BY col HAVING MAX(CASE WHEN cls IS NOT NULL THEN 1 ELSE 0 END) = 1)",
)
def masked_cell_count(spark, folder):
    facts = profile.column_facts(counted(spark, folder, "documents"))
    return facts.filter("sensitive_hits > 0").agg(F.coalesce(F.sum("non_empty"), F.lit(0)).alias("cells_masked"))


def column_profile_query(table):
    def run(spark, folder):
        df = text_table(spark, folder, table)
        counts = written(profile.cell_counts(df, df.columns), "counts")
        shown = profile.column_profile(df, counts, profile.column_facts(counts), Contract())
        top = F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["count"].cast("string")))
        return shown.select(
            "column", "inferred_type", "null_count", "distinct_count", "min_value", "max_value",
            F.array_join(top, "; ").alias("top_values"), "sensitive_hit_count", "withheld",
        )

    shown = f"CASE WHEN f.sensitive_hits > 0 OR t.cls IS NOT NULL THEN {sqltext.mask('t.cls')} ELSE t.value END"
    sql = (
        facts_sql(table)
        + f""", ranked AS (SELECT col, cls, cnt, value, ROW_NUMBER() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank
  FROM counts WHERE NOT blank),
tops AS (SELECT t.col, STRING_AGG({shown} || '=' || CAST(t.cnt AS STRING), '; ' ORDER BY t.rank) AS top_values
  FROM ranked t JOIN filled f ON f.col = t.col WHERE t.rank <= 5 GROUP BY t.col)
SELECT f.col AS "column", v.inferred_type, f.empty AS null_count, f.distinct_count,
  CASE WHEN f.sensitive_hits = 0 THEN {sqltext.edge('min')} END AS min_value,
  CASE WHEN f.sensitive_hits = 0 THEN {sqltext.edge('max')} END AS max_value,
  t.top_values, f.sensitive_hits AS sensitive_hit_count, f.sensitive_hits > 0 AS withheld
FROM filled f JOIN vote v ON v.col = f.col LEFT JOIN edges e ON e.col = f.col LEFT JOIN tops t ON t.col = f.col"""
    )
    query(f"column_profile_{table}", sql)(run)


for _table in ("orders", "part", "documents", "events"):
    column_profile_query(_table)


@query(
    "pattern_class_counts",
    f"WITH {sqltext.counts_sql('documents')} SELECT col AS \"column\", COALESCE(cls, 'text') AS pattern_class, CAST(SUM(cnt) AS BIGINT) AS cells FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank, MAX(CASE WHEN cls IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY col) AS hit "
    "FROM counts WHERE NOT blank) WHERE rank <= 5 AND hit = 1 GROUP BY 1, 2",
)
def pattern_class_counts(spark, folder):
    df = text_table(spark, folder, "documents")
    counts = written(profile.cell_counts(df, df.columns), "counts")
    shown = profile.column_profile(df, counts, profile.column_facts(counts), Contract())
    return (
        shown.select("column", F.explode("top_values").alias("t"))
        .filter("t.pattern_class IS NOT NULL")
        .groupBy("column", F.col("t.pattern_class").alias("pattern_class"))
        .agg(F.sum("t.count").alias("cells"))
    )


# -- duplicates and keys ---------------------------------------------------------------------
def document_records(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("record_uid"), "text", "lang")


@query(
    "exact_duplicates",
    "SELECT doc_id AS ordinal FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY text, lang ORDER BY doc_id) AS copy_no FROM documents) WHERE copy_no > 1",
)
def exact_duplicates(spark, folder):
    view = groups.identity_view(document_records(spark, folder), ["text", "lang"], {})
    return groups.surplus_records(view, written(groups.distinct_rows(view), "distinct")).select("ordinal")


@query(
    "duplicate_groups",
    "SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS exact_surplus, COUNT(*) FILTER (WHERE n > 1) AS exact_groups "
    "FROM (SELECT COUNT(*) AS n FROM documents GROUP BY text, lang)",
)
def duplicate_groups(spark, folder):
    view = groups.identity_view(document_records(spark, folder), ["text", "lang"], {})
    return groups.group_totals(groups.distinct_rows(view), None).select("exact_surplus", "exact_groups")


@query(
    "duplicated_row_flag",
    "SELECT doc_id AS ordinal, COUNT(*) OVER (PARTITION BY text, lang) > 1 AS duplicated FROM documents",
)
def duplicated_row_flag(spark, folder):
    view = groups.identity_view(document_records(spark, folder), ["text", "lang"], {})
    shared = groups.distinct_rows(view).filter("copies > 1").select("row_digest")
    hit = groups.join_back(view.select("ordinal", "row_digest"), shared, "row_digest", "ordinal").select("ordinal")
    rows = view.select("ordinal")
    return rows.join(hit.withColumn("duplicated", F.lit(True)), "ordinal", "left").select(
        "ordinal", F.coalesce("duplicated", F.lit(False)).alias("duplicated")
    )


def lineitem_records(spark, folder):
    """No unique key here, so a record is told apart by its content."""
    df = text_table(spark, folder, "lineitem")
    return df.select(F.xxhash64(*df.columns).alias("ordinal"), F.lit("").alias("record_uid"), *df.columns)


@query(
    "key_conflict_groups",
    "SELECT COUNT(*) AS key_groups, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS key_surplus FROM (SELECT COUNT(*) AS n FROM "
    "(SELECT DISTINCT * FROM lineitem) GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)",
)
def key_conflict_groups(spark, folder):
    df = lineitem_records(spark, folder)
    names = list(sqltext.text_columns("lineitem"))
    view = groups.identity_view(df, names, {"business_key": ["l_orderkey", "l_linenumber"]})
    return groups.group_totals(groups.distinct_rows(view), "business_key").select("key_groups", "key_surplus")


@query(
    "key_conflict_members",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n "
    "FROM (SELECT DISTINCT * FROM lineitem)) WHERE n > 1",
)
def key_conflict_members(spark, folder):
    df = read_table(spark, folder, "lineitem").dropDuplicates()
    keyed = df.select(
        groups.digest(["l_orderkey", "l_linenumber"]).alias("key"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    shared = groups.repeated(keyed, "key").select("key")
    return groups.join_back(keyed, shared, "key", "l_extendedprice").drop("key")


@query(
    "repeated_unique_values",
    "WITH " + feeds.feed_sql() + ", firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "
    + ", ".join(feeds.ORDER_NAMES)
    + " ORDER BY ordinal) AS copy_no FROM feed) SELECT ordinal FROM (SELECT ordinal, COUNT(*) OVER (PARTITION BY invoice) AS n FROM firsts "
    "WHERE copy_no = 1 AND regexp_matches(invoice, '\\S')) WHERE n > 1",
)
def repeated_unique_values(spark, folder):
    feed = feeds.orders_feed(spark, folder)
    view = groups.identity_view(feed, feeds.ORDER_NAMES, {"invoice": ["invoice"]})
    return groups.sharing_records(written(groups.distinct_rows(view), "distinct"), "invoice")


_SKETCHED = ["event_type", "user_id", "event_id"]


@query(
    "distinct_sketches",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) AS cells, COUNT(*) FILTER (WHERE trim(CAST({c} AS STRING)) <> '') AS filled, COUNT(DISTINCT CAST({c} AS STRING)) AS exact, TRUE AS within FROM events"""
        for c in _SKETCHED
    ),
)
def distinct_sketches(spark, folder):
    """Distinct values from sketches kept per day and merged, next to the exact counts."""
    events = read_table(spark, folder, "events")
    texts = events.select(F.to_date(F.col("ts").cast("timestamp")).cast("string").alias("day"), *[F.col(c).cast("string").alias(c) for c in _SKETCHED])
    per_day = written(sketches.summaries(texts, _SKETCHED, "day"), "sketches")
    found = sketches.compared(texts, _SKETCHED, sketches.merged(per_day))
    return found.select("column", "cells", "filled", "exact", "within")


@query(
    "python_pattern",
    "SELECT c_nationkey, COUNT(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]')) AS violations FROM customer GROUP BY 1",
)
def python_pattern(spark, folder):
    """A pattern with a scoped flag and a named group, which the engine's own compiler refuses."""
    rule = FieldRule(pattern=r"(?a:Customer#(?P<number>\d*)[02468])")
    bad = predicates.violations(F.col("c_name"), rule)["pattern"]
    return read_table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count_if(bad).alias("violations"))
