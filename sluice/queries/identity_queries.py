"""Identity, hashes and fingerprints over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import hashing
from sluice.operators import release
from sluice.queries import feeds, sqltext
from sluice.sources.tables import read_table, stringify, with_identity

QUERIES = {}
ORACLES = {}


def query(name, sql):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def prints_sql(digests: str) -> str:
    """SQL of the order-free fingerprint of a relation with a ``digest`` column."""
    lane = "CAST(SUM(CAST('0x' || SUBSTR(digest, {0}, 8) AS BIGINT)) AS BIGINT)"
    lanes = ", ".join(f"{lane.format(1 + 8 * i)} AS l{i}" for i in range(3))
    return f"""lines AS (SELECT bucket || ':' || n || ':' || l0 || ':' || l1 || ':' || l2 AS line, n FROM
  (SELECT SUBSTR(digest, 1, 3) AS bucket, COUNT(*) AS n, {lanes} FROM ({digests}) GROUP BY 1))
SELECT CAST(SUM(n) AS BIGINT) AS members, SHA256(STRING_AGG(line, chr(10) ORDER BY line)) AS fingerprint FROM lines"""


def encoded_sql(columns: list[str]) -> str:
    cells = [f"COALESCE(CAST(LENGTH({c}) AS STRING) || ':' || {c}, '-')" for c in columns]
    return " || '|' || ".join(cells)


@query("record_uid", "SELECT o_orderkey, SUBSTR(SHA256('orders:' || CAST(o_orderkey AS STRING)), 1, 24) AS record_uid FROM orders")
def record_uid(spark, folder):
    return with_identity(read_table(spark, folder, "orders"), "orders", "o_orderkey").select("o_orderkey", "record_uid")


@query(
    "scope_fingerprint",
    "WITH " + prints_sql("SELECT SUBSTR(SHA256('orders:' || CAST(o_orderkey AS STRING)), 1, 24) AS digest FROM orders"),
)
def scope_fingerprint(spark, folder):
    return release.scope_fingerprint(with_identity(read_table(spark, folder, "orders"), "orders", "o_orderkey"))


_LINES = sqltext.text_columns("lineitem")


@query(
    "table_fingerprint",
    f"WITH texts AS (SELECT {', '.join(f'{sql} AS {c}' for c, sql in _LINES.items())} FROM lineitem), "
    + prints_sql(f"SELECT SHA256({encoded_sql(list(_LINES))}) AS digest FROM texts"),
)
def table_fingerprint(spark, folder):
    df = stringify(read_table(spark, folder, "lineitem"))
    return release.table_fingerprint(df, df.columns)


@query(
    "row_digest",
    f"WITH {feeds.feed_sql()} SELECT ordinal, SHA256({encoded_sql(feeds.ORDER_NAMES)}) AS digest FROM feed",
)
def row_digest(spark, folder):
    return feeds.orders_feed(spark, folder).select("ordinal", hashing.row_digest(feeds.ORDER_NAMES).alias("digest"))


@query(
    "payload_hash",
    """SELECT event_id, SHA256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS payload_hash FROM events""",
)
def payload_hash(spark, folder):
    df = read_table(spark, folder, "events")
    return df.select("event_id", hashing.json_hash(F.struct("event_id", "event_type", "user_id")).alias("payload_hash"))


@query(
    "canonical_number",
    "SELECT event_id, CASE WHEN isfinite(value) THEN ROUND(value, 8) END AS value FROM events",
)
def canonical_number(spark, folder):
    return read_table(spark, folder, "events").select("event_id", hashing.canonical_number(F.col("value")).alias("value"))


@query("page_hashes", "SELECT page_id, SHA256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def page_hashes(spark, folder):
    return read_table(spark, folder, "pages").select(
        "page_id", F.sha2("html", 256).alias("content_hash"), F.octet_length("html").cast("bigint").alias("bytes")
    )
