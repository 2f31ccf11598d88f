"""Duplicates, business-key conflicts and repeated values without ever gathering a group.

A group is only ever reduced to (digest, size, first record). When its members are needed, the
few interesting groups are joined back to the rows: by broadcast when a count of the written
groups proves them small, otherwise by a shuffle of the rows that a bitmap of the groups leaves. There
the rows of large groups are salted, so a key that holds a third of the table is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.hashing import encoded
from sluice.functions.text import is_blank
from sluice.session import written

BROADCAST_GROUPS = 200_000  # rows of fixed width, about 100 bytes each: at most some 20 MB
SALTS = 16
SALTED_GROUP = 100_000  # members of a group that is salted where sizes are known: at most one such group per as many rows
FILTER_BITS = 1 << 24  # at most 262 144 words of 64 bits, whatever the number of groups


def digest(columns: list[str]) -> Column:
    """16 bytes per row instead of the row: the first half of a sha256."""
    return F.unhex(F.substring(F.sha2(encoded(columns), 256), 1, 32))


def identity_view(df: DataFrame, columns: list[str], keys: dict[str, list[str]]) -> DataFrame:
    """Narrow view: identity, whole-row digest and one digest per named key (null if any part is blank)."""
    key_columns = []
    for name, parts in keys.items():
        filled = F.lit(True)
        for part in parts:
            filled = filled & ~is_blank(F.col(f"`{part}`"))
        key_columns.append(F.when(filled, digest(parts)).alias(name))
    return df.select("ordinal", "record_uid", digest(columns).alias("row_digest"), *key_columns)


def distinct_rows(view: DataFrame) -> DataFrame:
    """One row per distinct record: its first occurrence and how often it occurs.

    A record's keys follow from its content, so they may travel as grouping columns.
    """
    keys = [c for c in view.columns if c not in ("ordinal", "record_uid")]
    return view.groupBy(*keys).agg(
        F.count("*").alias("copies"),
        F.min("ordinal").alias("first_ordinal"),
    )


def repeated(rows: DataFrame, key: str, size: str = "group_size") -> DataFrame:
    """Keys shared by more than one row of ``rows``; null keys never count."""
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias(size))
        .filter(F.col(size) > 1)
    )


def maybe_grouped(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those that belong to no group: a row stays if its key's bit is set in a bitmap of the groups' keys."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)).alias("filter_bit")
    word = F.shiftright("filter_bit", 6)
    bits = groups.select(bit).groupBy(word.alias("filter_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(filter_bit & 63 AS INT))")).alias("filter_bits"))
    marked = rows.select("*", bit).withColumn("filter_word", word).join(F.broadcast(bits), "filter_word")
    return marked.filter("getbit(filter_bits, CAST(filter_bit & 63 AS INT)) = 1").select(*rows.columns)


def join_back(
    rows: DataFrame, groups: DataFrame, key: str | list[str], spread: str, how: str = "inner", size: str | None = None
) -> DataFrame:
    """Join of rows with the groups they belong to (inner or left), safe against hot groups.

    ``groups`` has one fixed-width row per key; ``spread`` is a column of ``rows`` that varies
    inside a group. Where the column ``size`` of ``groups`` tells their members, only large groups are salted.
    """
    keys = [key] if isinstance(key, str) else key
    groups = written(groups, "groups")
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    if how == "inner":
        rows = maybe_grouped(rows, groups, keys)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if size is not None:
        large = F.col(size) > SALTED_GROUP
        named = groups.filter(large).select(*keys, F.lit(True).alias("salted"))
        rows = rows.join(F.broadcast(named), keys, "left")
        salt = F.when(F.col("salted"), salt).otherwise(0)
        salts = F.when(large, salts).otherwise(F.array(F.lit(0)))
    salted_rows = rows.withColumn("salt", salt).drop("salted")
    return salted_rows.join(groups.withColumn("salt", F.explode(salts)), [*keys, "salt"], how).drop("salt")


def surplus_records(view: DataFrame, distinct: DataFrame) -> DataFrame:
    """(ordinal, record_uid) of every occurrence after the first of an identical record."""
    groups = distinct.filter("copies > 1").select("row_digest", "first_ordinal", "copies")
    rows = view.select("ordinal", "record_uid", "row_digest")
    return join_back(rows, groups, "row_digest", "ordinal", size="copies").filter(
        F.col("ordinal") > F.col("first_ordinal")
    ).select("ordinal", "record_uid")


def sharing_records(distinct: DataFrame, key: str) -> DataFrame:
    """First ordinals of distinct records that share a key with a different record."""
    rows = distinct.select(key, "first_ordinal")
    return join_back(rows, repeated(distinct, key), key, "first_ordinal", size="group_size").select(
        F.col("first_ordinal").alias("ordinal")
    )


def group_totals(distinct: DataFrame, key: str | None) -> DataFrame:
    """One row: exact-duplicate and key-conflict groups with their surplus."""
    exact = distinct.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("exact_surplus"),
        F.count(F.when(F.col("copies") > 1, 1)).alias("exact_groups"),
    )
    if key is None:
        return exact.select("*", F.lit(0).cast("bigint").alias("key_surplus"), F.lit(0).cast("bigint").alias("key_groups"))
    conflicts = repeated(distinct, key).agg(
        F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("key_surplus"),
        F.count("*").alias("key_groups"),
    )
    one = F.lit(1).alias("one")
    return exact.select("*", one).join(conflicts.select("*", one), "one").drop("one")


def keyed(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, digest, ordinal): one row per distinct record and non-blank key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("digest")) for k in keys])
    return distinct.select(F.inline(pairs), F.col("first_ordinal").alias("ordinal")).filter("digest IS NOT NULL")


def marks(df: DataFrame, columns: list[str], business_key: list[str], unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """Marked records only: (ordinal, surplus, key_conflict, repeats) and the distinct-record table.

    ``repeats`` lists the unique fields whose value the record shares. All kinds of group go
    through one aggregation and one join.
    """
    keys = ({"business_key": business_key} if business_key else {}) | {
        f"unique_{name}": [name] for name in unique
    }
    return view_marks(identity_view(df, columns, keys))


def view_marks(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``marks`` from the narrow view alone, so views of several parts of a table may be put together first."""
    keys = [c for c in view.columns if c not in ("ordinal", "record_uid", "row_digest")]
    distinct = written(distinct_rows(view), "distinct")
    exact = distinct.filter("copies > 1").select(
        F.lit("exact").alias("kind"), F.col("row_digest").alias("digest"), "first_ordinal", F.col("copies").alias("n")
    )
    records = view.select(F.lit("exact").alias("kind"), F.col("row_digest").alias("digest"), "ordinal")
    if keys:
        firsts = keyed(distinct, keys)
        shared = firsts.groupBy("kind", "digest").agg(F.count("*").alias("n")).filter("n > 1")
        exact = exact.unionByName(shared.select("kind", "digest", F.lit(None).cast("bigint").alias("first_ordinal"), "n"))
        records = records.unionByName(firsts)
    hit = join_back(records, exact, ["kind", "digest"], "ordinal", size="n").filter(
        F.col("first_ordinal").isNull() | (F.col("ordinal") > F.col("first_ordinal"))
    )
    name = F.when(F.col("kind").startswith("unique_"), F.regexp_replace("kind", "^unique_", ""))
    # At most 2 + number of unique fields rows per ordinal.
    marked = hit.groupBy("ordinal").agg(
        F.bool_or(F.col("kind") == "exact").alias("surplus"),
        F.bool_or(F.col("kind") == "business_key").alias("key_conflict"),
        F.collect_set(name).alias("repeats"),
    )
    return marked, distinct
