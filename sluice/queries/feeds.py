"""Dirty feeds derived from the given tables.

The tables are typed and mostly clean, so each feed spells a whole table as text and lets the
calendar day of an order decide which legacy habit its row shows. Spark and the SQL oracle use
the same column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.contract import Contract
from sluice.sources.tables import read_table, with_identity

DATASET = "orders-feed"
DAY = "EXTRACT(DAY FROM o_orderdate)"
MONTH = "EXTRACT(MONTH FROM o_orderdate)"
KEY = "CAST(o_orderkey AS STRING)"
CUSTOMER = "CAST(o_custkey AS STRING)"
ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
YYYY, MM, DD = (f"SUBSTR({ISO}, {start}, {size})" for start, size in ((1, 4), (6, 2), (9, 2)))
AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"

ORDER_COLUMNS = {
    "order_id": f"'O' || {KEY}",
    "invoice": f"CASE WHEN {DAY} = 18 THEN 'INV-' || {YYYY} || {MM} ELSE 'INV-' || {KEY} END",
    "customer": f"CASE WHEN {DAY} = 3 THEN '  ' WHEN {DAY} = 23 AND o_orderstatus = 'F' THEN NULL "
    f"WHEN {DAY} = 27 THEN 'K' || {CUSTOMER} ELSE 'C' || {CUSTOMER} END",
    "status": f"CASE WHEN {DAY} = 4 AND o_orderstatus = 'F' THEN 'filled' "
    f"WHEN {DAY} = 4 AND o_orderstatus = 'O' THEN 'OPEN' WHEN {DAY} = 5 THEN LOWER(o_orderstatus) "
    f"WHEN {DAY} = 6 AND o_orderstatus = 'P' THEN 'pend?' WHEN {DAY} = 8 AND o_orderstatus = 'O' THEN 'X' "
    "ELSE o_orderstatus END",
    "phase": f"CASE WHEN o_orderstatus <> 'F' THEN 'open' WHEN {MONTH} = 2 THEN NULL "
    f"WHEN {MONTH} = 3 THEN 'open' ELSE 'closed' END",
    "total": f"CASE WHEN {DAY} = 9 THEN '-' || {AMOUNT} WHEN {DAY} = 10 THEN 'n/a' "
    f"WHEN {DAY} = 19 THEN '1e7' ELSE {AMOUNT} END",
    "order_date": f"CASE WHEN {DAY} = 25 THEN {DD} || '/' || {MM} || '/' || {YYYY} "
    f"WHEN {DAY} = 12 THEN {YYYY} || '/' || {MM} || '/' || {DD} "
    f"WHEN {DAY} = 7 THEN {YYYY} || {MM} || {DD} ELSE {ISO} END",
    "priority": f"CASE WHEN {DAY} = 14 THEN LOWER(o_orderpriority) "
    f"WHEN {DAY} = 15 THEN o_orderpriority || ' ' ELSE o_orderpriority END",
    "clerk_note": f"CASE WHEN {DAY} = 16 THEN 'mail clerk' || {CUSTOMER} || '@example.com' "
    f"WHEN {DAY} = 17 THEN 'call +65 9123 4567' WHEN {DAY} = 20 THEN 'Patient: ' || {CUSTOMER} "
    "ELSE 'no remark' END",
    "booked_at": f"CASE WHEN {DAY} = 22 THEN 'soon' ELSE {ISO} || 'T08:00:00Z' END",
    "express": f"CASE WHEN {DAY} = 24 THEN 'maybe' WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'No' END",
}
ORDER_NAMES = list(ORDER_COLUMNS)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

ORDER_CONTRACT = Contract.from_dict(
    {
        "id": "orders-feed",
        "version": "1.0.0",
        "business_key": ["order_id"],
        "fields": {
            "order_id": {"required": True, "unique": True},
            "invoice": {"unique": True},
            "customer": {"required": True, "pattern": "C[0-9]+"},
            "status": {
                "canonical": {"F": ["filled", "Filled"], "O": ["OPEN"], "P": ["pending"]},
                "allowed": ["F", "O", "P"],
                "semantic": True,
                "consistent_with": {"column": "phase", "expected": {"F": ["closed"]}},
            },
            "total": {"type": "number", "min": 0, "max": 600000},
            "order_date": {"type": "date", "format": "%Y-%m-%d", "accept_formats": ["%d/%m/%Y", "%Y/%m/%d"]},
            "priority": {"allowed": PRIORITIES, "max_length": 15},
            "clerk_note": {"sensitive": True},
            "booked_at": {"type": "datetime"},
            "express": {"type": "boolean"},
        },
        "ambiguity_registry": {"status": ["X"]},
        "auto_authorization": {
            "exact_duplicate_exclusion": True,
            "category_normalization": True,
            "date_standardization": True,
        },
    }
)

# On the 26th every order was sent twice; on the 21st it was sent again with another total.
SENT = f"CASE WHEN {DAY} = 26 THEN ARRAY(0, 1) WHEN {DAY} = 21 THEN ARRAY(0, 2) ELSE ARRAY(0) END"
ORDER_COLUMNS["total"] = f"CASE WHEN sending = 2 THEN '0.01' ELSE {ORDER_COLUMNS['total']} END"


def orders_feed(spark: SparkSession, folder: str) -> DataFrame:
    sent = read_table(spark, folder, "orders").selectExpr("*", f"EXPLODE({SENT}) AS sending")
    rows = sent.selectExpr("o_orderkey * 4 + sending AS ordinal", *[f"{sql} AS {name}" for name, sql in ORDER_COLUMNS.items()])
    return with_identity(rows, DATASET, "ordinal").select("ordinal", "record_uid", *ORDER_NAMES)


def feed_sql() -> str:
    """The same feed as a SQL common table expression named ``feed``."""
    columns = ", ".join(f"{sql} AS {name}" for name, sql in ORDER_COLUMNS.items())
    sent = (
        f"SELECT *, 0 AS sending FROM orders UNION ALL SELECT *, 1 FROM orders WHERE {DAY} = 26 "
        f"UNION ALL SELECT *, 2 FROM orders WHERE {DAY} = 21"
    )
    return (
        f"feed AS (SELECT *, SUBSTR(SHA256('{DATASET}:' || CAST(ordinal AS STRING)), 1, 24) AS record_uid "
        f"FROM (SELECT o_orderkey * 4 + sending AS ordinal, {columns} FROM ({sent})))"
    )
