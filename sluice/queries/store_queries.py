"""Stored runs of the orders gate: their hash trees, and what verification finds after rows were changed on storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.operators import decide
from sluice.plans import store
from sluice.queries import feeds
from sluice.queries.gate_queries import FINDINGS, LEDGER, executed, once
from sluice.queries.identity_queries import encoded_sql
from sluice.session import work_folder, written
from sluice.sources import files
from sluice.streaming.increments import Increments

QUERIES = {}
ORACLES = {}
DEPTH = 2


def query(name, sql):
    def register(function):
        QUERIES[name] = function
        ORACLES[name] = sql
        return function

    return register


def staged(spark, folder):
    outcome = executed(spark, folder)
    decisions = decide.default_decisions(outcome.plan.analysis.findings)
    return store.stage(outcome, decisions, f"{work_folder(spark)}/store-{uuid.uuid4().hex}", depth=DEPTH)


def stored(spark, folder):
    return once(spark, folder, "stored", lambda: staged(spark, folder))


_CELLS = encoded_sql(["CAST(ordinal AS VARCHAR)", "record_uid", *feeds.ORDER_NAMES])


@query(
    "stored_source_tree",
    f"""WITH {feeds.feed_sql()}, leaf AS (SELECT SUBSTR(record_uid, 1, 2) AS prefix, COUNT(*) AS members, SHA256(STRING_AGG(digest, '' ORDER BY digest)) AS digest
  FROM (SELECT record_uid, SHA256({_CELLS}) AS digest FROM feed) GROUP BY 1),
mid AS (SELECT SUBSTR(prefix, 1, 1) AS p, CAST(SUM(members) AS BIGINT) AS members, SHA256('node:' || STRING_AGG(digest, '' ORDER BY prefix)) AS digest FROM leaf GROUP BY 1),
top AS (SELECT CAST(SUM(members) AS BIGINT) AS members, SHA256('node:' || STRING_AGG(digest, '' ORDER BY p)) AS digest FROM mid)
SELECT 2 AS depth, prefix, members, digest FROM leaf UNION ALL SELECT 1, p, members, digest FROM mid UNION ALL SELECT 0, '', members, digest FROM top""",
)
def stored_source_tree(spark, folder):
    """The stored hash tree of the source's rows, from the leaves to the root."""
    return stored(spark, folder).nodes(spark).where("artifact = 'source'").select("depth", "prefix", "members", "digest")


@query(
    "stored_run_rows",
    LEDGER + """ SELECT 'source' AS artifact, COUNT(*) AS members, CAST(0 AS BIGINT) AS differing FROM feed UNION ALL SELECT 'candidate', COUNT(*), 0 FROM feed
UNION ALL SELECT 'release', COUNT(*), 0 FROM edits WHERE membership IS NULL UNION ALL SELECT 'ledger', COUNT(*), 0 FROM ledger""",
)
def stored_run_rows(spark, folder):
    """Records per stored artifact, and leaves that differ when a session that knows only the folder reads them again."""
    run = store.load(spark.newSession(), stored(spark, folder).folder)
    wrong = store.differences(spark, run).groupBy("artifact").agg(F.count("*").alias("differing"))
    tops = run.nodes(spark).where(F.col("artifact").isin(*store.RECORDS) & (F.col("depth") == 0)).select("artifact", "members")
    return tops.join(wrong, "artifact", "left").select("artifact", "members", F.coalesce("differing", F.lit(0)).alias("differing"))


@query(
    "stored_run_mutations",
    LEDGER + """, released AS (SELECT record_uid FROM edits WHERE membership IS NULL), low AS (SELECT SUBSTR(MIN(record_uid), 1, 2) AS p FROM released)
SELECT 'release' AS artifact, p AS prefix, 'altered' AS state, COUNT(*) AS stored, COUNT(*) AS found FROM released, low WHERE SUBSTR(record_uid, 1, 2) = p GROUP BY p
UNION ALL SELECT 'ledger', SUBSTR(f.record_uid, 1, 2), 'missing', COUNT(*), 0 FROM ledger g JOIN feed f ON f.ordinal = g.ordinal WHERE f.record_uid LIKE 'f%' GROUP BY 2""",
)
def stored_run_mutations(spark, folder):
    """One cell of the first released record is altered on storage and one bucket of the ledger removed: the leaves that verification names."""
    run = staged(spark, folder)
    released = run.table(spark, "release")
    low = released.agg(F.min("record_uid")).first()[0]
    bucket = f"{run.path('release')}/__bucket={low[:1]}"
    changed = run.table(spark, "release", low[:1]).withColumn("phase", F.when(F.col("record_uid") == low, F.lit("tampered")).otherwise(F.col("phase")))
    aside = f"{run.folder}/altered"
    changed.write.parquet(aside)
    files.delete(spark, bucket)
    files.move(spark, aside, bucket)
    files.delete(spark, f"{run.path('ledger')}/__bucket=f")
    return store.differences(spark, run, {"release": low[:1], "ledger": "f"})


@query(
    "incremental_findings",
    FINDINGS + " SELECT finding_id, finding_type, records AS affected_record_count, risk_level, blocking, authorization_mode, proposed_action FROM findings",
)
def incremental_findings(spark, folder):
    """The feed arrives in four batches, one of them twice: findings from the merged summaries."""
    feed = written(feeds.orders_feed(spark, folder), "feed")
    parts = Increments(spark, feeds.ORDER_CONTRACT, f"{work_folder(spark)}/increments-{uuid.uuid4().hex}")
    for batch in (0, 1, 2, 1, 3):
        parts.take(feed.where(F.pmod(F.xxhash64("ordinal"), F.lit(4)) == batch), batch)
    return parts.findings().select("finding_id", "finding_type", "affected_record_count", "risk_level", "blocking", "authorization_mode", "proposed_action")
