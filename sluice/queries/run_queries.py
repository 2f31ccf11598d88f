"""Many runs at once: the orders feed gated per booking month, and the events as a call log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.text import normalize_text
from sluice.operators import decide, detect, ground, runs
from sluice.queries.gate_queries import BASE, FINDINGS, RULES, analysed, executed, planned
from sluice.session import written
from sluice.sources.tables import read_table
from sluice.streaming import admission

QUERIES = {}
ORACLES = {}


def query(name, sql):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# -- findings and decisions per run ----------------------------------------------------------
RUN = "SUBSTR(booked_at, 1, 7)"
RUN_FINDINGS = f"""{BASE}, {RULES}, run_findings AS (SELECT r.run_id, r.finding_id, r.records, f.finding_type, f.risk_level, f.blocking, f.authorization_mode, f.allowed_outcomes
  FROM (SELECT {RUN} AS run_id, m.finding_id, COUNT(*) AS records FROM members m JOIN flagged g ON g.ordinal = m.ordinal GROUP BY 1, 2) r JOIN findings f ON f.finding_id = r.finding_id)"""
# February is left open, March was decided at an earlier revision, in April everything is excluded.
MONTH_OF = "SUBSTR(run_id, 6, 2)"
RUN_DECISIONS = RUN_FINDINGS + f""", run_decisions AS (SELECT run_id, finding_id, CASE WHEN {MONTH_OF} = '04' THEN 'EXCLUDE' WHEN allowed_outcomes LIKE '%APPROVE%' THEN 'APPROVE_PROPOSAL'
  WHEN allowed_outcomes LIKE 'EXCLUDE%' THEN 'EXCLUDE' ELSE 'QUARANTINE' END AS outcome, CASE WHEN {MONTH_OF} = '03' THEN 1 ELSE 2 END AS run_revision
  FROM run_findings WHERE authorization_mode <> 'POLICY_AUTHORIZED' AND {MONTH_OF} <> '02')"""


def run_findings(spark, folder):
    analysis = analysed(spark, folder)
    ids = F.array_distinct(F.transform("claims", lambda c: c["finding_id"]))
    counted = (
        analysis.annotated.select(F.substring("booked_at", 1, 7).alias("run_id"), F.explode(ids).alias("finding_id"))
        .groupBy("run_id", "finding_id").agg(F.count("*").alias("records"))
    )
    counted = written(counted, "run-findings")  # read for the findings and for their decisions
    fixed = spark.createDataFrame(detect.catalogue(analysis.contract, analysis.known), detect.CATALOGUE_SCHEMA)
    return counted.join(F.broadcast(fixed), "finding_id").drop("detector_rank", "column_rank", "zero_cells")


def run_decisions(found):
    month = F.substring("run_id", 6, 2)
    chosen = decide.default_decisions(found, 2, ["run_id"])
    return chosen.filter(month != "02").withColumn("outcome", F.when(month == "04", "EXCLUDE").otherwise(F.col("outcome"))).withColumn(
        "run_revision", F.when(month == "03", 1).otherwise(2)
    )


@query("run_findings", RUN_FINDINGS + " SELECT run_id, finding_id, records, risk_level, blocking FROM run_findings")
def run_findings_query(spark, folder):
    return run_findings(spark, folder).select("run_id", "finding_id", "records", "risk_level", "blocking")


@query(
    "run_dispositions",
    RUN_DECISIONS + """ SELECT f.run_id, f.finding_id, CASE WHEN f.authorization_mode = 'POLICY_AUTHORIZED' THEN 'POLICY_ACTION_APPROVED' WHEN d.outcome IS NULL OR d.run_revision <> 2 OR NOT (',' || f.allowed_outcomes || ',' LIKE '%,' || d.outcome || ',%') THEN NULL
  WHEN d.outcome = 'APPROVE_PROPOSAL' THEN 'HUMAN_ACTION_APPROVED' WHEN d.outcome = 'EXCLUDE' THEN 'EXCLUDED' ELSE 'QUARANTINED' END AS disposition,
  CASE WHEN f.authorization_mode = 'POLICY_AUTHORIZED' THEN NULL WHEN d.outcome IS NULL THEN 'UNRESOLVED_FINDINGS' WHEN d.run_revision <> 2 THEN 'DECISION_REVISION_MISMATCH'
  WHEN NOT (',' || f.allowed_outcomes || ',' LIKE '%,' || d.outcome || ',%') THEN 'OUTCOME_NOT_ALLOWED' END AS refusal
  FROM run_findings f LEFT JOIN run_decisions d ON d.run_id = f.run_id AND d.finding_id = f.finding_id""",
)
def run_dispositions(spark, folder):
    found = run_findings(spark, folder)
    return decide.dispositions(found, run_decisions(found), 2, ["run_id"]).select("run_id", "finding_id", "disposition", "refusal")


@query(
    "run_unresolved",
    RUN_DECISIONS + " SELECT run_id, finding_id FROM run_findings WHERE authorization_mode NOT IN ('POLICY_AUTHORIZED', 'FORBIDDEN') AND (run_id, finding_id) NOT IN (SELECT run_id, finding_id FROM run_decisions)",
)
def run_unresolved(spark, folder):
    found = run_findings(spark, folder)
    return decide.unresolved(found, run_decisions(found), ["run_id"])


@query(
    "duplicate_decisions",
    RUN_DECISIONS + " SELECT run_id, finding_id, COUNT(*) AS decisions FROM (SELECT run_id, finding_id FROM run_decisions UNION ALL SELECT run_id, finding_id FROM run_decisions WHERE outcome = 'EXCLUDE') GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def duplicate_decisions(spark, folder):
    decisions = run_decisions(run_findings(spark, folder))
    return decide.duplicate_decisions(decisions.unionByName(decisions.filter("outcome = 'EXCLUDE'")), ["run_id"])


@query(
    "surviving_decisions",
    RUN_DECISIONS + " SELECT run_id, finding_id, outcome FROM run_decisions d WHERE (run_id, finding_id) IN (SELECT run_id, finding_id FROM run_findings WHERE records > 1)",
)
def surviving_decisions(spark, folder):
    """Single-record findings vanish in the re-analysis, and their decisions with them."""
    found = run_findings(spark, folder)
    return decide.surviving_decisions(run_decisions(found), found.filter("records > 1"), ["run_id"]).select("run_id", "finding_id", "outcome")


@query("late_decisions", RUN_DECISIONS + " SELECT run_id, finding_id, CAST(run_revision AS BIGINT) AS run_revision FROM run_decisions WHERE run_revision <> 2")
def late_decisions(spark, folder):
    found = run_findings(spark, folder)
    current = found.select("run_id").distinct().withColumn("run_revision", F.lit(2))
    return decide.late_decisions(run_decisions(found), current, ["run_id"])[1].select(
        "run_id", "finding_id", F.col("run_revision").cast("bigint").alias("run_revision")
    )


@query(
    "finding_totals",
    RUN_FINDINGS + " SELECT risk_level, authorization_mode, blocking, COUNT(*) AS findings FROM run_findings GROUP BY GROUPING SETS ((risk_level), (authorization_mode), (blocking))",
)
def finding_totals(spark, folder):
    return runs.finding_totals(run_findings(spark, folder))


@query(
    "findings_filter",
    RUN_FINDINGS + " SELECT run_id, finding_id FROM run_findings WHERE blocking AND authorization_mode = 'QUARANTINE_ONLY'",
)
def findings_filter(spark, folder):
    return run_findings(spark, folder).filter("blocking AND authorization_mode = 'QUARANTINE_ONLY'").select("run_id", "finding_id")


@query(
    "run_status",
    RUN_FINDINGS + " SELECT run_id, COUNT(*) AS findings, COUNT(*) FILTER (WHERE blocking) AS blocking_findings, CASE WHEN BOOL_OR(blocking) THEN 'BLOCKED' ELSE 'CONDITIONAL_PASS' END AS release_status FROM run_findings GROUP BY 1",
)
def run_status(spark, folder):
    blocking = F.coalesce(F.bool_or("blocking"), F.lit(False))
    return run_findings(spark, folder).groupBy("run_id").agg(
        F.count("*").alias("findings"), F.count(F.when(F.col("blocking"), 1)).alias("blocking_findings"),
        F.when(blocking, "BLOCKED").otherwise("CONDITIONAL_PASS").alias("release_status"),
    )


@query(
    "membership_owner",
    FINDINGS + ", kept AS (SELECT m.record_uid, m.finding_id FROM members m JOIN findings f ON f.finding_id = m.finding_id WHERE f.authorization_mode <> 'POLICY_AUTHORIZED' AND f.allowed_outcomes = 'QUARANTINE' OR m.finding_id LIKE 'VAL-%' AND f.finding_id = m.finding_id) "
    "SELECT record_uid, COUNT(*) AS claims, MIN(finding_id) AS first_finding, MAX(finding_id) AS last_finding FROM kept GROUP BY record_uid",
)
def membership_owner(spark, folder):
    """First and last action, in finding order, among those that would quarantine a record."""
    analysis = analysed(spark, folder)
    names = [r[0] for r in analysis.findings.filter("proposed_action = 'QUARANTINE_RECORDS'").select("finding_id").orderBy("finding_id").collect()]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("finding_id"))
    listed = detect.members(analysis.annotated).filter(F.col("finding_id").isin(*names)).select(
        F.lit("QUARANTINED").alias("status"), F.lit("row").alias("column"), "record_uid", rank.alias("action_rank")
    )
    name = F.array(*[F.lit(n) for n in names])
    first = runs.first_owner(listed).select("record_uid", F.element_at(name, F.col("action_rank").cast("int")).alias("first_finding"))
    last = runs.last_owner(listed).select("record_uid", F.element_at(name, F.col("action_rank").cast("int")).alias("last_finding"))
    size = listed.groupBy("record_uid").agg(F.count("*").alias("claims"))
    return size.join(first, "record_uid").join(last, "record_uid")


@query(
    "named_facts",
    FINDINGS + ", t AS (SELECT (SELECT COUNT(*) FROM feed) AS record_count, COUNT(*) AS finding_total, COUNT(*) FILTER (WHERE risk_level = 'HIGH') AS finding_high, "
    "COUNT(*) FILTER (WHERE risk_level = 'MEDIUM') AS finding_medium, COUNT(*) FILTER (WHERE risk_level = 'LOW') AS finding_low, COUNT(*) FILTER (WHERE blocking) AS blocking_open FROM findings) "
    "SELECT UNNEST(['record_count', 'finding_total', 'finding_high', 'finding_medium', 'finding_low', 'blocking_open']) AS fact_id, "
    "UNNEST([CAST(record_count AS STRING), CAST(finding_total AS STRING), CAST(finding_high AS STRING), CAST(finding_medium AS STRING), CAST(finding_low AS STRING), CAST(blocking_open AS STRING)]) AS value FROM t",
)
def named_facts(spark, folder):
    analysis = analysed(spark, folder)
    return runs.named_facts(fact_row(analysis))


def fact_row(analysis):
    def risk(level):
        return F.count(F.when(F.col("risk_level") == level, 1))

    found = analysis.findings.agg(
        F.count("*").alias("finding_total"), risk("HIGH").alias("finding_high"), risk("MEDIUM").alias("finding_medium"),
        risk("LOW").alias("finding_low"), F.count(F.when(F.col("blocking"), 1)).alias("blocking_open"), F.lit(1).alias("one"),
    )
    size = analysis.source.agg(F.count("*").alias("record_count"), F.lit(1).alias("one"))
    return size.join(found, "one").drop("one")


# -- event log and call log ------------------------------------------------------------------
def event_table(spark, folder):
    return read_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("event_sequence", "SELECT event_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark, folder):
    return runs.sequenced(event_table(spark, folder), "user_id", "ts", "event_id").select("event_id", "user_id", "seq")


@query(
    "event_sequence_after_stored",
    "WITH stored AS (SELECT user_id, COUNT(*) AS last_seq FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.event_id, e.user_id, "
    "COALESCE(s.last_seq, 0) + ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS seq FROM events e LEFT JOIN stored s ON s.user_id = e.user_id WHERE e.event_type <> 'signup'",
)
def event_sequence_after_stored(spark, folder):
    events = event_table(spark, folder)
    last = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("last_seq"))
    return runs.sequenced(events.filter("event_type <> 'signup'"), "user_id", "ts", "event_id", last).select("event_id", "user_id", "seq")


@query(
    "replay_after",
    "SELECT event_id, user_id, seq FROM (SELECT event_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 40",
)
def replay_after(spark, folder):
    log = runs.sequenced(event_table(spark, folder), "user_id", "ts", "event_id")
    return runs.replay(log, 40).select("event_id", "user_id", "seq")


@query(
    "daily_budget",
    "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, LEAST(COUNT(*), 300) AS calls_used, GREATEST(COUNT(*) - 300, 0) AS refused, COUNT(*) >= 300 AS exhausted FROM events GROUP BY 1",
)
def daily_budget(spark, folder):
    return runs.daily_budget(event_table(spark, folder), "ts", 300).withColumn("day", F.col("day").cast("string"))


@query(
    "daily_admitted",
    "SELECT event_id FROM (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 300",
)
def daily_admitted(spark, folder):
    return runs.daily_admitted(event_table(spark, folder), "ts", "event_id", 300).select("event_id")


@query(
    "call_usage",
    "SELECT user_id, COUNT(*) AS calls, COUNT(*) FILTER (WHERE event_type = 'error') AS live_calls, COUNT(*) FILTER (WHERE event_type = 'error') > 8 AS over_cap FROM events GROUP BY 1",
)
def call_usage(spark, folder):
    return runs.call_usage(event_table(spark, folder), "user_id", F.col("event_type") == "error")


@query(
    "idempotent_apply",
    "WITH firsts AS (SELECT user_id, FIRST(event_type ORDER BY ts, event_id) AS winning_key, FIRST(event_id ORDER BY ts, event_id) AS winner FROM events GROUP BY 1) "
    "SELECT e.event_id, CASE WHEN e.event_id = f.winner THEN 'APPLIED' WHEN e.event_type = f.winning_key THEN 'REPLAYED' ELSE 'REFUSED' END AS outcome FROM events e JOIN firsts f ON f.user_id = e.user_id",
)
def idempotent_apply(spark, folder):
    return runs.idempotent(event_table(spark, folder), "user_id", "event_type", "ts", "event_id").select("event_id", "outcome")


@query(
    "retention_expiry",
    "WITH c AS (SELECT user_id, MIN(ts) AS created_at, MAX(ts) AS seen FROM events GROUP BY 1), n AS (SELECT MAX(ts) AS now FROM events) "
    "SELECT 'run-' || user_id AS run_id FROM c, n WHERE created_at <= now - INTERVAL 696 HOURS AND user_id > 9 AND seen < now - INTERVAL 8 HOURS",
)
def retention_expiry(spark, folder):
    """Runs (one per user) created 29 days before the last event; the first ten are public, recent ones active."""
    events = event_table(spark, folder)
    now = F.lit(events.agg(F.max("ts")).first()[0])
    per_run = events.groupBy(F.concat(F.lit("run-"), "user_id").alias("run_id"), "user_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("seen")
    )
    active = per_run.filter(F.col("seen") >= now - F.expr("INTERVAL 8 HOURS")).select("run_id")
    return runs.expired(per_run, active, now, 696, F.col("user_id") <= 9).select("run_id")


@query(
    "run_search",
    "SELECT 'run-' || user_id AS run_id FROM (SELECT user_id, MAX(event_type) AS lifecycle FROM events GROUP BY 1) WHERE lifecycle = 'view' AND '-' || user_id LIKE '%-1%'",
)
def run_search(spark, folder):
    per_run = event_table(spark, folder).groupBy("user_id").agg(F.max("event_type").alias("lifecycle"), F.min("ts").alias("created_at"))
    listed = per_run.select(F.concat(F.lit("run-"), "user_id").alias("run_id"), F.lit("").alias("name"), "lifecycle", "created_at")
    return runs.search(listed, "view", "RUN-1").select("run_id")


ADMISSION = """WITH RECURSIVE ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch(CAST(ts AS TIMESTAMP)) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
st AS (
  SELECT key, n, event_id, true AS allowed, CAST(0 AS BIGINT) AS retry_after, [sec] AS times FROM ev WHERE n = 1
  UNION ALL
  SELECT key, n, event_id, len(f) < 3, CASE WHEN len(f) < 3 THEN 0 ELSE greatest(CAST(ceil(f[1] + 3600 - sec) AS BIGINT), 1) END,
    CASE WHEN len(f) < 3 THEN list_append(f, sec) ELSE f END
  FROM (SELECT ev.key, ev.n, ev.event_id, ev.sec, list_filter(st.times, lambda t: t > ev.sec - 3600) AS f FROM st JOIN ev ON ev.key = st.key AND ev.n = st.n + 1))
SELECT event_id, key, allowed, retry_after FROM st"""


@query("sliding_admission", ADMISSION)
def sliding_admission(spark, folder):
    """Three admitted events per user and hour."""
    at = F.col("ts").cast("timestamp").cast("double")
    events = read_table(spark, folder, "events").select("event_id", F.col("user_id").cast("string").alias("key"), at.alias("at"))
    return admission.admission(events, 3, 3600.0)


# -- proposals -------------------------------------------------------------------------------
# Every market segment of every nation is a request; each customer proposes to map its segment.
GROUNDING = """WITH requests AS (SELECT DISTINCT c_nationkey AS request_id FROM customer),
candidates AS (SELECT c_nationkey AS request_id, c_mktsegment AS value, COUNT(*) AS cnt FROM customer GROUP BY 1, 2),
proposals AS (SELECT c_custkey AS proposal_id, c_nationkey AS request_id, CASE WHEN c_acctbal < 0 THEN 'SEM-other' ELSE 'SEM-segment' END AS finding_id,
  CASE WHEN c_acctbal > 9500 THEN 'name' ELSE 'segment' END AS col, CASE WHEN c_acctbal BETWEEN 0 AND 300 THEN 'old' ELSE 'hash' END AS input_hash,
  CASE WHEN c_acctbal BETWEEN 300 AND 600 THEN 'DELETE_ROWS' ELSE 'NORMALIZE_CATEGORY' END AS action, c_acctbal BETWEEN 600 AND 900 AS abstained,
  CASE WHEN c_acctbal BETWEEN 900 AND 1200 THEN LOWER(c_mktsegment) ELSE c_mktsegment END AS source,
  CASE WHEN c_acctbal BETWEEN 1200 AND 1500 THEN 'ELSEWHERE' ELSE 'GOODS' END AS target,
  CASE WHEN c_acctbal BETWEEN 1500 AND 1800 THEN 'EVID-FAKE-99' ELSE 'EVID-VOCAB-01' END AS ref FROM customer),
checked AS (SELECT p.*, c.cnt, c.cnt IS NULL AS unseen, p.source = 'MACHINERY' AND p.request_id = 3 AS ambiguous FROM proposals p LEFT JOIN candidates c ON c.request_id = p.request_id AND c.value = p.source),
reasoned AS (SELECT *, concat_ws(',', CASE WHEN finding_id <> 'SEM-segment' THEN 'UNKNOWN_FINDING' END, CASE WHEN col <> 'segment' THEN 'UNKNOWN_COLUMN' END,
  CASE WHEN input_hash <> 'hash' THEN 'STALE_OR_UNKNOWN_INPUT' END, CASE WHEN unseen THEN 'HALLUCINATED_SOURCE_VALUE' END, CASE WHEN target <> 'GOODS' THEN 'UNKNOWN_CANONICAL_TARGET' END,
  CASE WHEN ref <> 'EVID-VOCAB-01' THEN 'UNKNOWN_EVIDENCE_REFERENCE' END, CASE WHEN ambiguous THEN 'AMBIGUITY_REGISTRY_HIT' END,
  CASE WHEN action <> 'NORMALIZE_CATEGORY' THEN 'UNSUPPORTED_ACTION' END, CASE WHEN abstained THEN 'ABSTENTION_WITH_MAPPING' END) AS reasons FROM checked)"""


def proposal_tables(spark, folder):
    customer = read_table(spark, folder, "customer")
    balance = F.col("c_acctbal")
    request = F.col("c_nationkey").alias("request_id")
    asked = customer.select(request).distinct().select(
        "request_id", F.lit("SEM-segment").alias("finding_id"), F.lit("segment").alias("column"), F.lit("hash").alias("input_hash")
    )
    candidates = customer.groupBy(request, F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("cnt"))
    vocabulary = asked.select("request_id", F.lit("GOODS").alias("value"))
    ambiguity = asked.filter("request_id = 3").select("request_id", F.lit("MACHINERY").alias("value"))
    evidence = asked.select("request_id", F.lit("EVID-VOCAB-01").alias("value"))
    source = F.when(balance.between(900, 1200), F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    target = F.when(balance.between(1200, 1500), "ELSEWHERE").otherwise("GOODS")
    proposals = customer.select(
        F.col("c_custkey").alias("proposal_id"), request,
        F.when(balance < 0, "SEM-other").otherwise("SEM-segment").alias("finding_id"),
        F.when(balance > 9500, "name").otherwise("segment").alias("column"),
        F.when(balance.between(0, 300), "old").otherwise("hash").alias("input_hash"),
        F.when(balance.between(300, 600), "DELETE_ROWS").otherwise("NORMALIZE_CATEGORY").alias("action"),
        balance.between(600, 900).alias("abstained"),
        F.create_map(source, target).alias("mapping"),
        F.array(F.when(balance.between(1500, 1800), "EVID-FAKE-99").otherwise("EVID-VOCAB-01")).alias("evidence_refs"),
    )
    return proposals, asked, candidates, vocabulary, ambiguity, evidence


@query(
    "mapping_grounding",
    GROUNDING + " SELECT proposal_id, reasons = '' AS valid, reasons, CASE WHEN reasons = '' AND NOT abstained THEN cnt ELSE 0 END AS affected_records FROM reasoned",
)
def mapping_grounding(spark, folder):
    checked = ground.ground_mappings(*proposal_tables(spark, folder))
    return checked.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "approvable_proposals",
    GROUNDING + " SELECT proposal_id FROM reasoned WHERE reasons = '' AND NOT abstained",
)
def approvable_proposals(spark, folder):
    tables = proposal_tables(spark, folder)
    checked = ground.ground_mappings(*tables).select("proposal_id", F.col("valid").alias("grounded"))
    return tables[0].join(checked, "proposal_id").filter(ground.proposal_is_approvable()).select("proposal_id")


@query(
    "semantic_stage_summary",
    GROUNDING + " SELECT request_id, COUNT(*) FILTER (WHERE NOT abstained AND reasons = '') AS proposals, COUNT(*) FILTER (WHERE abstained) AS abstained, COUNT(*) FILTER (WHERE NOT abstained AND reasons <> '') AS rejected FROM reasoned GROUP BY 1",
)
def semantic_stage_summary(spark, folder):
    tables = proposal_tables(spark, folder)
    checked = ground.ground_mappings(*tables).select("proposal_id", F.col("valid").alias("grounded"))
    joined = tables[0].select("proposal_id", "request_id", "abstained").join(checked, "proposal_id")
    return runs.semantic_summary(joined, "request_id")


@query(
    "proposals_against_calls",
    GROUNDING + " SELECT proposal_id, request_id <> 7 AS call_exists, request_id <> 7 AND finding_id = 'SEM-segment' AS same_finding, request_id <> 7 AND input_hash = 'hash' AS same_input FROM proposals",
)
def proposals_against_calls(spark, folder):
    """The call log holds one call per request; the one of nation 7 was never recorded."""
    proposals, asked, *_ = proposal_tables(spark, folder)
    calls = asked.filter("request_id <> 7").withColumnRenamed("request_id", "call_id")
    return runs.proposals_against_calls(proposals.withColumnRenamed("request_id", "call_id"), calls)


@query(
    "proposal_replay",
    "WITH stored AS (SELECT 'SEM-' || c_nationkey AS finding_id, c_mktsegment AS source, 'A' AS target FROM customer GROUP BY 1, 2), fresh AS (SELECT finding_id, source, 'B' AS target FROM stored) "
    "SELECT * FROM stored WHERE finding_id <> 'SEM-5' UNION ALL SELECT * FROM fresh WHERE finding_id = 'SEM-5'",
)
def proposal_replay(spark, folder):
    base = read_table(spark, folder, "customer").select(
        F.concat(F.lit("SEM-"), F.col("c_nationkey").cast("string")).alias("finding_id"), F.col("c_mktsegment").alias("source")
    ).distinct()
    return ground.replayed(base.withColumn("target", F.lit("A")), base.withColumn("target", F.lit("B")), "SEM-5")


@query("normalized_spellings", "SELECT p_type, LOWER(TRIM(p_type)) AS norm, COUNT(*) AS parts FROM part GROUP BY 1, 2")
def normalized_spellings(spark, folder):
    counted = read_table(spark, folder, "part").groupBy("p_type").agg(F.count("*").alias("parts"))
    return counted.withColumn("norm", normalize_text("p_type"))


# Drafted rules: part columns against what the part table shows.
DRAFT = (
    ("p_brand", "required", None, "true"), ("p_brand", "allowed", None, "Brand#4"), ("p_type", "allowed", None, "PROMO"), ("p_type", "allowed", None, "LUXURY"),
    ("p_size", "type", None, "number"), ("p_size", "format", None, "%Y-%m-%d"), ("p_retailprice", "type", None, "integer"), ("p_name", "sensitive", None, "false"),
    ("p_colour", "required", None, "true"), ("p_type", "evidence", None, "PROFILE:p_type:distinct"), ("p_type", "evidence", "2", "PROFILE:p_type:smell"),
    ("p_type", "canonical", "SMALL", "SMALL"), ("p_type", "canonical", "SMALL", "TINY"),
)


@query(
    "rule_grounding",
    """WITH tops AS (SELECT p_type AS v FROM (SELECT p_type, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5)),
brands AS (SELECT p_brand AS v FROM (SELECT p_brand, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5))
SELECT 'p_brand' AS field, 'required' AS rule, NULL AS item, NULL AS reason
UNION ALL SELECT 'p_brand', 'allowed', NULL, CASE WHEN 'Brand#4' IN (SELECT v FROM brands) THEN NULL ELSE 'UNOBSERVED_VALUE' END
UNION ALL SELECT 'p_type', 'allowed', NULL, CASE WHEN 'PROMO' IN (SELECT v FROM tops) AND 'LUXURY' IN (SELECT v FROM tops) THEN NULL ELSE 'UNOBSERVED_VALUE' END
UNION ALL SELECT 'p_size', 'type', NULL, NULL UNION ALL SELECT 'p_size', 'format', NULL, 'UNKNOWN_FORMAT' UNION ALL SELECT 'p_retailprice', 'type', NULL, 'TYPE_MISMATCH'
UNION ALL SELECT 'p_name', 'sensitive', NULL, 'SENSITIVE_DOWNGRADE' UNION ALL SELECT 'p_colour', 'field', NULL, 'UNKNOWN_COLUMN'
UNION ALL SELECT 'p_type', 'evidence', NULL, NULL UNION ALL SELECT 'p_type', 'evidence', '2', 'UNKNOWN_EVIDENCE'
UNION ALL SELECT 'p_type', 'canonical', 'SMALL', CASE WHEN 'SMALL' IN (SELECT v FROM tops) AND 'TINY' IN (SELECT v FROM tops) THEN NULL ELSE 'UNOBSERVED_VALUE' END""",
)
def rule_grounding(spark, folder):
    shown, formats = part_profile(spark, folder)
    draft = spark.createDataFrame(list(DRAFT), "field string, rule string, item string, value string")
    return ground.ground_rules(draft, shown, ground.observed_values(shown), formats)


# Drafted spellings of the market segments, the same for every nation: what a nation doesn't show is refused there.
SPELLINGS = (
    (0, "BUILDING", ["MACHINERY", "BUILDING", "MACHINERY"]), (1, "MACHINERY", ["AUTOMOBILE"]), (2, "FURNITURE", ["MACHINERY", "HOUSEHOLD"]),
    (3, "AUTOMOBILE", ["BUILDING"]), (4, "AUTOMOBILE", ["FURNITURE", "HOUSEHOLD"]), (5, "HOUSEHOLD", ["UNHEARD"]),
)
_ENTRIES = ", ".join(f"({p}, '{t}', [{', '.join(repr(a) for a in dict.fromkeys(aliases))}])" for p, t, aliases in SPELLINGS)


@query(
    "alias_grounding",
    f"""WITH RECURSIVE shown AS (SELECT c_nationkey AS field, list(DISTINCT c_mktsegment) AS vals FROM customer GROUP BY 1),
e AS (SELECT * FROM (VALUES {_ENTRIES}) AS v(position, target, aliases)),
st AS (
  SELECT field, vals, -1 AS position, CAST([] AS VARCHAR[]) AS targets, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS target, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS status FROM shown
  UNION ALL
  SELECT field, vals, position, CASE WHEN status = 'ACCEPTED' THEN list_append(targets, target) ELSE targets END,
    CASE WHEN status = 'ACCEPTED' THEN list_concat(taken, free) ELSE taken END, target, CASE WHEN status = 'ACCEPTED' THEN free ELSE CAST([] AS VARCHAR[]) END, status
  FROM (SELECT *, CASE WHEN NOT list_has_all(vals, list_append(aliases, target)) THEN 'REJECTED' WHEN len(free) > 0 AND NOT list_contains(taken, target) THEN 'ACCEPTED' ELSE 'SKIPPED' END AS status
    FROM (SELECT st.field, st.vals, st.targets, st.taken, e.position, e.target, e.aliases,
      list_filter(e.aliases, lambda a: a <> e.target AND NOT list_contains(st.taken, a) AND NOT list_contains(st.targets, a)) AS free FROM st JOIN e ON e.position = st.position + 1)))
SELECT field, position, target, array_to_string(kept, ',') AS aliases, status FROM st WHERE position >= 0""",
)
def alias_grounding(spark, folder):
    customers = read_table(spark, folder, "customer")
    shown = customers.select(F.col("c_nationkey").alias("column"), F.col("c_mktsegment").alias("value")).distinct()
    entries = spark.createDataFrame(list(SPELLINGS), "position int, target string, aliases array<string>")
    drafted = customers.select(F.col("c_nationkey").alias("field")).distinct().join(F.broadcast(entries))
    return ground.ground_aliases(drafted, shown).withColumn("aliases", F.array_join("aliases", ","))


def part_profile(spark, folder):
    from sluice.contract import Contract
    from sluice.operators import profile
    from sluice.plans import gate
    from sluice.sources.tables import stringify

    df = stringify(read_table(spark, folder, "part"))
    counts, facts = gate.profiled(df)
    return written(profile.column_profile(df, counts, facts, Contract()), "profile"), ground.observed_formats(facts)


@query(
    "table_rule_grounding",
    """WITH tops AS (SELECT p_type AS v FROM (SELECT p_type, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5))
SELECT 'business_key' AS rule, 'p_partkey' AS "column", NULL AS value, NULL AS reason UNION ALL SELECT 'business_key', 'p_code', NULL, 'UNKNOWN_COLUMN'
UNION ALL SELECT 'ambiguity', 'p_type', 'MEDIUM', CASE WHEN 'MEDIUM' IN (SELECT v FROM tops) THEN NULL ELSE 'UNOBSERVED_VALUE' END UNION ALL SELECT 'ambiguity', 'p_type', 'ODD', 'UNOBSERVED_VALUE'""",
)
def table_rule_grounding(spark, folder):
    shown, _ = part_profile(spark, folder)
    draft = spark.createDataFrame(
        [("business_key", "p_partkey", None), ("business_key", "p_code", None), ("ambiguity", "p_type", "MEDIUM"), ("ambiguity", "p_type", "ODD")],
        "rule string, column string, value string",
    )
    return ground.ground_table_rules(draft, shown.select("column"), ground.observed_values(shown))


# -- narrative claims: every document and conversation turn as a claim about the release ------
_FACTS = """facts AS (SELECT COUNT(*) AS n, MIN(n_chars) AS lo, MAX(n_chars) AS hi FROM documents)"""
_TOKENS = r"""tokens AS (SELECT DISTINCT doc_id AS claim_id, regexp_replace(tok, '[,.]+$', '') AS token FROM
  (SELECT doc_id, UNNEST(regexp_extract_all(regexp_replace(text, '\d+(?:\.\d+){2,}', ' ', 'g'), '\d[\d,]*(?:\.\d+)?')) AS tok FROM documents))"""
_BAD = f"""{_FACTS}, {_TOKENS}, bad AS (SELECT claim_id, token FROM tokens, facts WHERE token <> '' AND COALESCE(TRY_CAST(replace(token, ',', '') AS DECIMAL(38,10)) NOT IN (n, lo, hi), TRUE)
  AND NOT contains('release 2024', replace(token, ',', '')) AND NOT contains('record_count', replace(token, ',', '')))"""


def document_facts(spark, folder):
    row = read_table(spark, folder, "documents").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi")).first()
    return [("record_count", row["n"]), ("shortest", row["lo"]), ("longest", row["hi"]), ("title", "release 2024")]


def document_claims(spark, folder):
    docs = read_table(spark, folder, "documents")
    ids = F.array(F.lit("record_count"), F.when(F.col("lang") == "en", "longest").otherwise("slowest"))
    return docs.select(F.col("doc_id").alias("claim_id"), "text", ids.alias("fact_ids"))


@query("unverified_numbers", f"WITH {_BAD} SELECT claim_id, token FROM bad")
def unverified_numbers(spark, folder):
    return ground.unverified_numbers(document_claims(spark, folder), document_facts(spark, folder))


@query("unknown_facts", "SELECT doc_id AS claim_id, 'slowest' AS fact_id FROM documents WHERE lang <> 'en'")
def unknown_facts(spark, folder):
    names = spark.createDataFrame([(n,) for n, _ in document_facts(spark, folder)], "fact_id string")
    return ground.unknown_facts(document_claims(spark, folder), names).select("claim_id", "fact_id")


@query(
    "claim_verification",
    f"WITH {_BAD}, numbers AS (SELECT claim_id, STRING_AGG(token, ',' ORDER BY token) AS t FROM bad GROUP BY 1) "
    "SELECT d.doc_id AS claim_id, d.lang = 'en' AND t IS NULL AS verified, NULLIF(concat_ws('; ', CASE WHEN d.lang <> 'en' THEN 'UNKNOWN_FACT:slowest' END, 'UNVERIFIED_NUMBER:' || t), '') AS reason "
    "FROM documents d LEFT JOIN numbers n ON n.claim_id = d.doc_id",
)
def claim_verification(spark, folder):
    return ground.verify_claims(document_claims(spark, folder), document_facts(spark, folder))


@query(
    "conservation_audit",
    FINDINGS + " SELECT TRUE AS rows_conserve, TRUE AS dispositions_conserve, TRUE AS ledger_conserves, (SELECT COUNT(*) FROM findings) AS findings",
)
def conservation_audit(spark, folder):
    """Released, quarantined and excluded rows add up; every finding has one disposition; the ledger joins the actions."""
    outcome = executed(spark, folder)
    plan = planned(spark, folder)
    one = F.lit(1).alias("one")
    kept = outcome.table.agg(F.count("*").alias("released"), one)
    gone = outcome.membership().agg(F.count(F.when(F.col("membership") != "FLAGGED", 1)).alias("removed"), one)
    size = plan.analysis.source.agg(F.count("*").alias("records"), one)
    labels = spark.createDataFrame(sorted(plan.changes.dispositions.items()), "finding_id string, disposition string")
    pairs = plan.analysis.findings.select("finding_id", F.lit(True).alias("raised")).join(labels, "finding_id", "full_outer")
    held = pairs.agg(F.bool_and(F.col("raised").isNotNull() & F.col("disposition").isNotNull()).alias("dispositions_conserve"), F.count("*").alias("findings"), one)
    actions = decide.action_table(plan.changes, spark).select("finding_id", "action_type").distinct()
    orphan = outcome.ledger.join(actions, ["finding_id", "action_type"], "left_anti").agg((F.count("*") == 0).alias("ledger_conserves"), one)
    return kept.join(gone, "one").join(size, "one").join(held, "one").join(orphan, "one").select(
        (F.col("released") + F.col("removed") == F.col("records")).alias("rows_conserve"), "dispositions_conserve", "ledger_conserves", "findings"
    )
