"""Sources and sinks: published tables read back through the intake, logs and bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.operators import detect, release
from sluice.plans import gate
from sluice.queries import sqltext
from sluice.queries.gate_queries import APPLIED, LEDGER, analysed, executed, planned
from sluice.session import work_folder, written
from sluice.sources import blocks, delimited, logs
from sluice.sources.tables import read_table, stringify
from sluice.streaming.logs import EVENT_SCHEMA

QUERIES = {}
ORACLES = {}


def query(name, sql):
    def register(function):
        QUERIES[name] = function
        ORACLES[name] = sql
        return function

    return register


def fresh(spark, name):
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_query(table):
    def run(spark, folder):
        path = fresh(spark, table)
        logs.publish(stringify(read_table(spark, folder, table)), path, "csv")
        return delimited.intake(spark, path)[0].drop("ordinal", "record_uid")

    columns = ", ".join(f"{sql} AS {name}" for name, sql in sqltext.text_columns(table).items())
    query(f"csv_intake_{table}", f"SELECT {columns} FROM {table}")(run)


# Documents hold line breaks and quotes, the others are plain.
for _table in ("customer", "orders", "documents"):
    csv_query(_table)


@query("csv_ordinals", "SELECT COUNT(*) AS records, COUNT(*) AS ordinals, CAST(0 AS BIGINT) AS first_ordinal, COUNT(*) - 1 AS last_ordinal FROM lineitem")
def csv_ordinals(spark, folder):
    """Positions given to the rows of a published table: every one from 0 to n - 1, once."""
    path = fresh(spark, "lineitem")
    logs.publish(stringify(read_table(spark, folder, "lineitem")), path, "csv")
    table = delimited.intake(spark, path)[0]
    return table.agg(
        F.count("*").alias("records"), F.count_distinct("ordinal").alias("ordinals"),
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"),
    )


@query("csv_row_order", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def csv_row_order(spark, folder):
    """Orders published in key order over several files get the ordinals of that order back."""
    path = fresh(spark, "ordered")
    orders = read_table(spark, folder, "orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey")
    logs.publish(stringify(orders), path, "csv")
    return delimited.intake(spark, path)[0].select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "ordinal")


def tree_sql(leaf: int, fanout: int, levels: int) -> str:
    """Hash trees of the texts in ``body`` (part, content: ASCII); levels beyond a tree's height leave its root as it is."""
    steps = [
        f"""n0 AS (SELECT part, length(content) AS length, CAST(ceil(length(content) / {leaf}) AS BIGINT) AS leaves, i AS node,
  sha256(substr(content, 1 + i * {leaf}, {leaf})) AS digest FROM body, unnest(range(0, CAST(ceil(length(content) / {leaf}) AS BIGINT))) AS t(i))"""
    ]
    for k in range(levels):
        steps.append(
            f"""n{k + 1} AS (SELECT part, length, leaves, node // {fanout} AS node,
  CASE WHEN max(wide) = 1 THEN max(digest) ELSE sha256('node:' || string_agg(digest, '' ORDER BY node)) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY part) AS wide FROM n{k}) GROUP BY part, length, leaves, n{k}.node // {fanout})""".replace(f"n{k}.node", "node")
        )
    return ",\n".join(steps) + f"\nSELECT part, length, leaves, digest AS root FROM n{levels}"


@query(
    "file_trees",
    """WITH body AS (SELECT CAST(o_orderkey // 16384 AS BIGINT) AS part, 'o_orderkey,o_custkey,o_orderstatus' || chr(10) ||
  string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS content FROM orders GROUP BY 1),
"""
    + tree_sql(4096, 4, 8),
)
def file_trees(spark, folder):
    """Hash trees of the CSV files of the orders, a file for every 16 384 keys."""
    path = fresh(spark, "tree")
    keyed = stringify(read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    parted = keyed.withColumn("key", F.col("o_orderkey").cast("bigint")).withColumn("part", F.expr("key div 16384"))
    ordered = parted.repartition("part").sortWithinPartitions("part", "key").drop("key")
    ordered.write.option("header", "true").partitionBy("part").csv(path)
    trees = blocks.file_trees(spark, path, 4096, 4)
    return trees.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"), "length", "leaves", "root")


PLACES = """SELECT page_id, html, ROW_NUMBER() OVER (ORDER BY page_id) - 1 AS ordinal FROM pages"""


@query("csv_quoted_order", PLACES)
def csv_quoted_order(spark, folder):
    """Pages, full of quoted line breaks, published in order over several files: text and order come back, however files are split."""
    path = fresh(spark, "pages")
    pages = read_table(spark, folder, "pages").select("page_id", "html").repartitionByRange(4, "page_id").sortWithinPartitions("page_id")
    logs.publish(stringify(pages), path, "csv")
    return delimited.intake(spark, path)[0].select(F.col("page_id").cast("bigint").alias("page_id"), "html", "ordinal")


@query("csv_layout", "SELECT ',' AS delimiter, 'utf-8' AS encoding, CAST(3 AS BIGINT) AS columns, MAX(contains(html, chr(10))) AS multi_line FROM pages")
def csv_layout(spark, folder):
    path = fresh(spark, "pages")
    logs.publish(stringify(read_table(spark, folder, "pages")), path, "csv")
    layout = delimited.detect_layout(spark, path)
    row = [(layout.delimiter, layout.encoding, len(layout.columns), layout.multi_line)]
    return spark.createDataFrame(row, "delimiter string, encoding string, columns bigint, multi_line boolean")


@query(
    "event_log_append",
    "SELECT 'run-' || user_id AS run_id, event_type AS stage, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, ts, event_id) AS seq FROM events",
)
def event_log_append(spark, folder):
    """Two appends to one log: the second continues the numbers of the first."""
    path = fresh(spark, "log")
    events = read_table(spark, folder, "events").select(
        F.concat(F.lit("run-"), "user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"),
        F.lit("COMPLETED").alias("status"), F.format_string("%012d", "event_id").alias("message"),
    )
    logs.append_events(spark, events.filter("stage = 'signup'"), path, EVENT_SCHEMA)
    logs.append_events(spark, events.filter("stage <> 'signup'"), path, EVENT_SCHEMA)
    return logs.read_log(spark, path, EVENT_SCHEMA).select("run_id", "stage", "seq")


@query(
    "audit_bundle",
    LEDGER + " SELECT 'findings' AS part, COUNT(*) AS records FROM findings UNION ALL SELECT 'ledger', COUNT(*) FROM ledger UNION ALL SELECT 'membership', COUNT(*) FROM memberships "
    "UNION ALL SELECT 'manifest', 1 UNION ALL SELECT 'validations', 14",
)
def audit_bundle(spark, folder):
    outcome = executed(spark, folder)
    parts = {
        "findings": outcome.plan.analysis.findings, "ledger": outcome.ledger, "membership": outcome.membership(),
        "manifest": outcome.manifest(), "validations": outcome.validations(),
    }
    path = fresh(spark, "bundle")
    logs.write_report(logs.audit_bundle(parts, "orders"), path)
    return spark.read.schema("run_id string, part string, payload string").json(path).groupBy("part").agg(F.count("*").alias("records"))


@query(
    "privacy_snapshot",
    LEDGER + ' SELECT col AS "column", action_type, finding_id, COUNT(*) AS entries FROM ledger GROUP BY ALL',
)
def privacy_snapshot(spark, folder):
    """The ledger without identities and values, counted."""
    plan = planned(spark, folder)
    entries = logs.snapshot(release.ledger(plan.rows, plan.changes, plan.analysis.contract, plan.analysis.known))
    return entries.groupBy("column", "action_type", "finding_id").agg(F.count("*").alias("entries"))


DOCUMENT_CONTRACT = Contract.from_dict(
    {
        "id": "documents", "version": "1", "business_key": ["doc_code"],
        "fields": {"text": {"semantic": True}, "source": {"sensitive": True}, "licence": {"required": True}, "lang": {"semantic": True, "canonical": {"en": ["eng"]}}},
    }
)


@query(
    "gate_warnings",
    f"""WITH t AS (SELECT COUNT(*) FILTER (WHERE {sqltext.sensitive('text')} IS NOT NULL) AS text_hits, COUNT(*) FILTER (WHERE {sqltext.sensitive('source')} IS NOT NULL) AS source_hits,
  COUNT(*) FILTER (WHERE lang NOT IN ('en', 'eng')) AS unlisted FROM documents)
SELECT 'KEY_COLUMN_MISSING' AS code, 'doc_code' AS "column" UNION ALL SELECT 'FIELD_MISSING', 'licence' UNION ALL SELECT 'SEMANTIC_WITHHELD', 'text' FROM t WHERE text_hits > 0
UNION ALL SELECT 'UNDECLARED_SENSITIVE', 'text' FROM t WHERE text_hits > 0 UNION ALL SELECT 'SENSITIVE_WITHOUT_HIT', 'source' FROM t WHERE source_hits = 0
UNION ALL SELECT 'OPEN_VOCABULARY_UNMAPPED', 'lang' FROM t WHERE unlisted > 0""",
)
def gate_warnings(spark, folder):
    known = detect.learn(stringify(read_table(spark, folder, "documents")), DOCUMENT_CONTRACT)
    return spark.createDataFrame(detect.warnings(DOCUMENT_CONTRACT, known), "code string, column string")


@query(
    "quarantine_precedence",
    APPLIED + """, flagged_ids AS (SELECT DISTINCT ordinal FROM members WHERE finding_id LIKE 'VAL-%'),
held AS (SELECT DISTINCT ordinal FROM members WHERE finding_id IN ('DUP-KEY', 'SEM-status-CONFLICT', 'AMB-status', 'MISS-customer')),
surplus AS (SELECT ordinal FROM members WHERE finding_id = 'DUP-EXACT')
SELECT membership, COUNT(*) AS records FROM (SELECT CASE WHEN ordinal IN (SELECT ordinal FROM held) THEN 'QUARANTINED' WHEN ordinal IN (SELECT ordinal FROM surplus) THEN 'EXCLUDED'
  WHEN ordinal IN (SELECT ordinal FROM flagged_ids) THEN 'FLAGGED' END AS membership FROM feed) WHERE membership IS NOT NULL GROUP BY 1""",
)
def quarantine_precedence(spark, folder):
    """Violations are flagged instead of quarantined: quarantine beats exclusion beats flagging."""
    from sluice.operators import decide

    analysis = gate.settled(analysed(spark, folder))
    decisions = decide.default_decisions(analysis.findings)
    flag = F.when(F.col("finding_id").startswith("VAL-"), "FLAG_FOR_REVIEW").otherwise(F.col("outcome"))
    counts = written(detect.claim_counts(analysis.annotated), "claim-counts")
    changes = decide.change_set(analysis.findings, decisions.withColumn("outcome", flag), analysis.contract, analysis.known, counts)
    rows = release.applied(analysis.annotated, changes, analysis.known)
    return rows.filter(F.col("membership").isNotNull()).groupBy("membership").agg(F.count("*").alias("records"))
