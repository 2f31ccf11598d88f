"""The gate on the orders feed: findings, metrics, decisions, release and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.functions import patterns
from sluice.functions.text import is_blank
from sluice.operators import decide, detect, ground, metrics, profile, release, semantic
from sluice.plans import gate
from sluice.queries import feeds, sqltext
from sluice.queries.feeds import ORDER_CONTRACT, ORDER_NAMES
from sluice.queries.sqltext import blank, match
from sluice.session import lean_shuffles, written
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


# One run of the gate serves every report about it. The bench empties this before each query.
RUNS = {}


def once(spark, folder, stage, build):
    key = (spark.sparkContext.applicationId, folder, stage)
    if key not in RUNS:
        RUNS[key] = build()
    return RUNS[key]


def analysed(spark, folder):
    """The feed is taken in once, as any source is, and then analysed."""
    return once(spark, folder, "analysis", lambda: gate.analyse(written(feeds.orders_feed(spark, folder), "intake"), ORDER_CONTRACT))


def planned(spark, folder):
    def build():
        analysis = gate.settled(analysed(spark, folder))
        return gate.dry_run(analysis, decide.default_decisions(analysis.findings))

    return once(spark, folder, "plan", build)


def executed(spark, folder):
    return once(spark, folder, "release", lambda: gate.execute(planned(spark, folder)))


# -- oracle SQL: every claim of every row ----------------------------------------------------
ALIASES = {"filled": "F", "Filled": "F", "OPEN": "O", "pending": "P"}
MAPPED = {"f": "F", "o": "O", "p": "P"}
VOCABULARY = ("F", "O", "P", *ALIASES)


def listed(values):
    return ", ".join(f"'{v}'" for v in values)


CONFLICT = "(status IN ('filled','Filled','f') AND COALESCE(phase <> 'closed', TRUE))"
NUMBER = f"CASE WHEN {match('total', patterns.DECIMAL_RX)} THEN TRY_CAST(total AS DOUBLE) END"
ISO_OK = "try_strptime(order_date, '%Y-%m-%d') IS NOT NULL AND regexp_matches(order_date, '-')"
DMY_OK = "try_strptime(order_date, '%d/%m/%Y') IS NOT NULL"
YMD_OK = "try_strptime(order_date, '%Y/%m/%d') IS NOT NULL"
NONE = "CAST(NULL AS VARCHAR)"

CLAIMS = [
    ("DUP-EXACT", NONE, "copy_no > 1"),
    ("DUP-KEY", NONE, f"copy_no = 1 AND NOT {blank('order_id')} AND key_size > 1"),
    ("CAT-status", "status", f"status IN ({listed(ALIASES)}) AND NOT {CONFLICT}"),
    ("FMT-order_date", "'%d/%m/%Y'", f"NOT ({ISO_OK}) AND {DMY_OK}"),
    ("FMT-order_date", "'%Y/%m/%d'", f"NOT ({ISO_OK}) AND {YMD_OK}"),
    ("SEM-status", "status", f"status IN ({listed(MAPPED)}) AND NOT {CONFLICT}"),
    ("SEM-status-CONFLICT", "status", CONFLICT),
    ("AMB-status", "status", "status = 'X'"),
    ("MISS-customer", NONE, blank("customer")),
    ("VAL-invoice", "'unique'", f"copy_no = 1 AND NOT {blank('invoice')} AND invoice_size > 1"),
    ("VAL-customer", "'pattern'", f"NOT {blank('customer')} AND NOT {match('customer', '^(?:C[0-9]+)$')}"),
    ("VAL-status", "'allowed'", f"NOT {blank('status')} AND status NOT IN ({listed((*VOCABULARY, 'X', *MAPPED))})"),
    ("VAL-total", "'type'", f"NOT {blank('total')} AND NOT {match('total', patterns.DECIMAL_RX)}"),
    ("VAL-total", "'range'", f"NOT {blank('total')} AND COALESCE({NUMBER} < 0 OR {NUMBER} > 600000, TRUE)"),
    ("VAL-order_date", "'type'", f"NOT {blank('order_date')} AND NOT ({ISO_OK}) AND NOT ({DMY_OK}) AND NOT ({YMD_OK})"),
    ("VAL-priority", "'max_length'", "LENGTH(priority) > 15"),
    ("VAL-priority", "'allowed'", f"NOT {blank('priority')} AND priority NOT IN ({listed(feeds.PRIORITIES)})"),
    ("VAL-booked_at", "'type'", f"NOT {blank('booked_at')} AND NOT {match('booked_at', patterns.ISO_DATETIME_RX)}"),
    ("VAL-express", "'type'", f"NOT {blank('express')} AND NOT {sqltext.boolean('express')}"),
    ("PHI-clerk_note", sqltext.sensitive("clerk_note"), f"{sqltext.sensitive('clerk_note')} IS NOT NULL"),
]
_NAMES = ", ".join(ORDER_NAMES)
_CLAIMS = " UNION ALL ".join(
    f"SELECT '{fid}' AS finding_id, {detail} AS detail, ordinal, record_uid FROM flagged WHERE {holds}" for fid, detail, holds in CLAIMS
)
BASE = f"""WITH {feeds.feed_sql()},
copies AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_NAMES} ORDER BY ordinal) AS copy_no FROM feed),
flagged AS (SELECT *, COUNT(*) FILTER (WHERE copy_no = 1) OVER (PARTITION BY order_id) AS key_size,
  COUNT(*) FILTER (WHERE copy_no = 1) OVER (PARTITION BY invoice) AS invoice_size FROM copies),
claims AS ({_CLAIMS}),
members AS (SELECT DISTINCT finding_id, ordinal, record_uid FROM claims)"""

# finding id prefix: type, risk, blocking, mode, action, allowed outcomes
RULES = f"""rules AS (SELECT * FROM (VALUES
  ('DUP-EXACT','EXACT_DUPLICATE','LOW',FALSE,'POLICY_AUTHORIZED','EXCLUDE_EXACT_DUPLICATE_FROM_RELEASE','APPROVE_PROPOSAL,REJECT_PROPOSAL'),
  ('DUP-KEY','BUSINESS_KEY_CONFLICT','HIGH',TRUE,'QUARANTINE_ONLY','QUARANTINE_RECORDS','QUARANTINE'),
  ('CAT','CATEGORY_VARIANT','LOW',FALSE,'POLICY_AUTHORIZED','NORMALIZE_CATEGORY','APPROVE_PROPOSAL,REJECT_PROPOSAL'),
  ('FMT','FORMAT_INCONSISTENCY','LOW',FALSE,'POLICY_AUTHORIZED','STANDARDIZE_DATE_FORMAT','APPROVE_PROPOSAL,REJECT_PROPOSAL'),
  ('SEM','SEMANTIC_VARIANT','MEDIUM',TRUE,'HUMAN_APPROVAL_REQUIRED','NORMALIZE_CATEGORY','APPROVE_PROPOSAL,QUARANTINE,REJECT_PROPOSAL'),
  ('CONFLICT','SEMANTIC_CONFLICT','HIGH',TRUE,'QUARANTINE_ONLY','QUARANTINE_RECORDS','QUARANTINE'),
  ('AMB','KNOWN_AMBIGUOUS_TOKEN','HIGH',TRUE,'QUARANTINE_ONLY','QUARANTINE_RECORDS','QUARANTINE'),
  ('MISS','REQUIRED_FIELD_MISSING','HIGH',TRUE,'QUARANTINE_ONLY','QUARANTINE_RECORDS','QUARANTINE'),
  ('VAL','VALIDITY_VIOLATION','MEDIUM',TRUE,'HUMAN_APPROVAL_REQUIRED','QUARANTINE_RECORDS','QUARANTINE,FLAG_FOR_REVIEW'),
  ('PHI','POTENTIAL_DIRECT_IDENTIFIER','HIGH',TRUE,'HUMAN_APPROVAL_REQUIRED','EXCLUDE_COLUMN_FROM_RELEASE','EXCLUDE,QUARANTINE')
  ) AS r(kind, finding_type, risk_level, blocking, authorization_mode, proposed_action, allowed_outcomes)),
found AS (SELECT m.finding_id, COUNT(*) AS records,
  CASE WHEN m.finding_id LIKE 'DUP-%' THEN m.finding_id WHEN m.finding_id LIKE '%-CONFLICT' THEN 'CONFLICT' ELSE split_part(m.finding_id, '-', 1) END AS kind
  FROM members m GROUP BY m.finding_id),
findings AS (SELECT f.finding_id, f.records, r.* FROM found f JOIN rules r ON r.kind = f.kind)"""
FINDINGS = f"{BASE}, {RULES}"


@query(
    "gate_findings",
    FINDINGS + " SELECT finding_id, finding_type, records AS affected_record_count, "
    "CASE WHEN finding_id = 'DUP-EXACT' THEN 0 ELSE records END AS affected_cell_count, risk_level, blocking, "
    "authorization_mode, proposed_action, allowed_outcomes FROM findings",
)
def gate_findings(spark, folder):
    return analysed(spark, folder).findings.select(
        "finding_id", "finding_type", "affected_record_count", "affected_cell_count", "risk_level", "blocking",
        "authorization_mode", "proposed_action", F.array_join("allowed_outcomes", ",").alias("allowed_outcomes"),
    )


@query("gate_members", BASE + " SELECT finding_id, ordinal, record_uid FROM members")
def gate_members(spark, folder):
    return detect.members(analysed(spark, folder).annotated)


@query("gate_claim_details", BASE + " SELECT finding_id, detail, COUNT(*) AS records FROM claims GROUP BY ALL")
def gate_claim_details(spark, folder):
    return detect.claim_counts(analysed(spark, folder).annotated)


_EXAMPLES = " UNION ALL ".join(
    f"SELECT '{fid}' AS finding_id, {detail} AS kind, {fid.split('-', 1)[1]} AS value FROM flagged WHERE {holds}"
    for fid, detail, holds in CLAIMS
    if fid.startswith("VAL-") and "unique" not in detail
)


@query(
    "violation_examples",
    BASE + f", bad AS ({_EXAMPLES}), counted AS (SELECT finding_id, kind, value, COUNT(*) AS cnt FROM bad GROUP BY ALL), "
    "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY finding_id, kind ORDER BY cnt DESC, value) AS rank, "
    "COUNT(*) OVER (PARTITION BY finding_id, kind) AS distinct_values, SUM(cnt) OVER (PARTITION BY finding_id, kind) AS records FROM counted) "
    "SELECT finding_id, kind, CAST(MAX(records) AS BIGINT) AS records, MAX(distinct_values) AS distinct_values, "
    f"STRING_AGG(value, '; ' ORDER BY rank) FILTER (WHERE rank <= 10 AND {sqltext.sensitive('value')} IS NULL) AS examples FROM ranked GROUP BY 1, 2",
)
def violation_examples(spark, folder):
    analysis = analysed(spark, folder)
    shown = detect.violation_summary(analysis.annotated, ORDER_CONTRACT, analysis.known)
    return shown.select("finding_id", "kind", "records", "distinct_values", F.array_join("examples", "; ").alias("examples"))


@query(
    "sample_members",
    BASE + " SELECT finding_id, record_uid FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY finding_id ORDER BY ordinal) AS rank FROM members) WHERE rank <= 20",
)
def sample_members(spark, folder):
    return detect.samples(detect.members(analysed(spark, folder).annotated)).select("finding_id", "record_uid")


@query(
    "finding_rows_masked",
    BASE + f""" SELECT finding_id, f.ordinal, f.order_id, {sqltext.mask(sqltext.sensitive('f.clerk_note'))} AS clerk_note FROM
  (SELECT finding_id, ordinal, ROW_NUMBER() OVER (PARTITION BY finding_id ORDER BY ordinal) AS rank FROM members) m JOIN flagged f ON f.ordinal = m.ordinal WHERE rank <= 20""",
)
def finding_rows_masked(spark, folder):
    analysis = analysed(spark, folder)
    rows = detect.masked_rows(analysis.source, detect.samples(detect.members(analysis.annotated)), ORDER_CONTRACT, analysis.known)
    return rows.select("finding_id", "ordinal", "order_id", "clerk_note")


_VALID = {
    "customer": match("customer", "^(?:C[0-9]+)$"),
    "total": f"{match('total', patterns.DECIMAL_RX)} AND {NUMBER} BETWEEN 0 AND 600000",
    "order_date": ISO_OK,
    "priority": "LENGTH(priority) <= 15",
    "booked_at": match("booked_at", patterns.ISO_DATETIME_RX),
    "express": sqltext.boolean("express"),
}


def cell_sum(parts):
    return "CAST(SUM(" + " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in parts) + ") AS BIGINT)"


def filled(name):
    return f"NOT {blank(name)}"


_CONSISTENT = [
    f"{filled('status')} AND status IN ({listed(VOCABULARY)})",
    f"{filled('priority')} AND priority IN ({listed(feeds.PRIORITIES)})",
]
METRICS = f"""{BASE}, sums AS (SELECT COUNT(*) AS n, {cell_sum([filled('order_id'), filled('customer')])} AS c_num,
  {cell_sum([f'{filled(k)} AND {v}' for k, v in _VALID.items()])} AS v_num, {cell_sum([filled(k) for k in _VALID])} AS v_den,
  {cell_sum(_CONSISTENT)} AS s_num, {cell_sum([filled('status'), filled('priority')])} AS s_den,
  COUNT(*) FILTER (WHERE copy_no > 1) AS surplus FROM flagged),
keys AS (SELECT CAST(COALESCE(SUM(k - 1), 0) AS BIGINT) AS key_surplus FROM (SELECT COUNT(*) AS k FROM flagged WHERE copy_no = 1 AND {filled('order_id')} GROUP BY order_id HAVING COUNT(*) > 1)),
scored AS (SELECT 'completeness' AS metric, c_num AS numerator, 2 * n AS denominator FROM sums UNION ALL SELECT 'validity', v_num, v_den FROM sums
  UNION ALL SELECT 'consistency', s_num, s_den FROM sums UNION ALL SELECT 'uniqueness', GREATEST(n - surplus - key_surplus, 0), n FROM sums, keys)"""


@query("gate_metrics", METRICS + " SELECT metric, numerator, denominator, denominator > 0 AS applicable FROM scored")
def gate_metrics(spark, folder):
    return analysed(spark, folder).metrics.drop("score")


@query(
    "overall_score",
    METRICS + " SELECT CAST(FLOOR(10 * SUM(100.0 * numerator / denominator * w) / SUM(w)) AS BIGINT) AS tenths FROM scored JOIN "
    "(VALUES ('completeness', 0.30), ('validity', 0.25), ('consistency', 0.25), ('uniqueness', 0.20)) AS weights(metric, w) USING (metric) WHERE denominator > 0",
)
def overall_score(spark, folder):
    score = metrics.overall_score(analysed(spark, folder).metrics, ORDER_CONTRACT)
    return score.select(F.floor(F.col("overall_score") * 10).alias("tenths"))


@query(
    "initial_status",
    FINDINGS + " SELECT CASE WHEN BOOL_OR(blocking) THEN 'BLOCKED' ELSE 'CONDITIONAL_PASS' END AS release_status, COUNT(*) AS findings FROM findings",
)
def initial_status(spark, folder):
    return detect.initial_status(analysed(spark, folder).findings, ORDER_CONTRACT)


@query(
    "findings_in_order",
    FINDINGS + ", ordered AS (SELECT finding_id, blocking, risk_level FROM findings) SELECT finding_id, ROW_NUMBER() OVER (ORDER BY blocking DESC, "
    "CASE risk_level WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, finding_id) AS position FROM ordered",
)
def findings_in_order(spark, folder):
    """Presentation order of one run's findings, a table as long as the columns are many."""
    return detect.presentation_order(analysed(spark, folder).findings).select(
        "finding_id", F.col("position").cast("bigint").alias("position")
    )


# -- without a contract ----------------------------------------------------------------------
# Mostly ISO dates with exactly one other family: the remaining spellings of the feed are blanked.
@query(
    "observational_findings",
    f"WITH {feeds.feed_sql()}, dates AS (SELECT *, CASE WHEN regexp_matches(order_date, '^[0-9]{{4}}/|^[0-9]{{8}}') THEN NULL ELSE order_date END AS shown FROM feed), "
    "copies AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, shown, clerk_note ORDER BY ordinal) AS copy_no FROM dates) "
    "SELECT * FROM (SELECT 'DUP-EXACT' AS finding_id, COUNT(*) AS affected_record_count, FALSE AS blocking, 'FORBIDDEN' AS authorization_mode FROM copies WHERE copy_no > 1 "
    "UNION ALL SELECT 'FMT-order_date', COUNT(*), FALSE, 'FORBIDDEN' FROM dates WHERE regexp_matches(shown, '/') "
    f"UNION ALL SELECT 'PHI-clerk_note', COUNT(*), FALSE, 'FORBIDDEN' FROM feed WHERE {sqltext.sensitive('clerk_note')} IS NOT NULL) WHERE affected_record_count > 0",
)
def observational_findings(spark, folder):
    feed = feeds.orders_feed(spark, folder)
    other = F.col("order_date").rlike("^[0-9]{4}/|^[0-9]{8}")
    shown = F.when(~other, F.col("order_date")).alias("order_date")
    source = written(feed.select("ordinal", "record_uid", "order_id", shown, "clerk_note"), "intake")
    return gate.analyse(source, Contract()).findings.select("finding_id", "affected_record_count", "blocking", "authorization_mode")


@query(
    "observational_metrics",
    sqltext.facts_sql("feed", {n: n for n in ORDER_NAMES}, feeds.feed_sql())
    + f""", copies AS (SELECT ROW_NUMBER() OVER (PARTITION BY {_NAMES} ORDER BY ordinal) AS copy_no FROM feed)
SELECT 'completeness' AS metric, CAST(SUM(n) AS BIGINT) AS numerator, CAST(SUM(row_count) AS BIGINT) AS denominator FROM filled
UNION ALL SELECT 'validity', CAST(SUM(type_match) AS BIGINT), CAST(SUM(n) AS BIGINT) FROM vote WHERE inferred_type NOT IN ('string', 'empty')
UNION ALL SELECT 'consistency', 0, 0
UNION ALL SELECT 'uniqueness', COUNT(*) FILTER (WHERE copy_no = 1), COUNT(*) FROM copies""",
)
def observational_metrics(spark, folder):
    return gate.analyse(written(feeds.orders_feed(spark, folder), "intake"), Contract()).metrics.select("metric", "numerator", "denominator")


# -- semantic candidates ---------------------------------------------------------------------
_UNLISTED = (
    f"SELECT 'status' AS col, status AS value, COUNT(*) AS cnt FROM feed WHERE {filled('status')} AND status NOT IN ({listed((*VOCABULARY, 'X'))}) "
    f"AND LENGTH(status) <= 64 AND {sqltext.sensitive('status')} IS NULL GROUP BY status"
)


@query(
    "semantic_candidates",
    f"WITH {feeds.feed_sql()}, unlisted AS ({_UNLISTED}) SELECT col AS \"column\", value, cnt, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank FROM unlisted) WHERE rank <= 30",
)
def semantic_candidates(spark, folder):
    found = semantic.candidates(semantic.unlisted_counts(feeds.orders_feed(spark, folder), ORDER_CONTRACT, []))
    return found.withColumn("rank", F.col("rank").cast("bigint"))


NAMES_CONTRACT = Contract.from_dict(
    {"id": "customers", "version": "1", "fields": {"c_name": {"semantic": True, "allowed": ["none"]}, "c_mktsegment": {"semantic": True, "allowed": ["none"]}}}
)


@query(
    "candidates_truncated",
    "SELECT 'c_name' AS \"column\", COUNT(DISTINCT c_name) AS total, COUNT(DISTINCT c_name) > 30 AS truncated FROM customer "
    "UNION ALL SELECT 'c_mktsegment', COUNT(DISTINCT c_mktsegment), COUNT(DISTINCT c_mktsegment) > 30 FROM customer",
)
def candidates_truncated(spark, folder):
    from sluice.sources.tables import read_table

    df = read_table(spark, folder, "customer")
    return semantic.truncated(semantic.unlisted_counts(df, NAMES_CONTRACT, []))


@query(
    "top_candidates",
    "SELECT 'c_name' AS \"column\", c_name AS value FROM (SELECT c_name FROM customer GROUP BY c_name ORDER BY COUNT(*) DESC, c_name LIMIT 30) "
    "UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer)",
)
def top_candidates(spark, folder):
    from sluice.sources.tables import read_table

    df = read_table(spark, folder, "customer")
    return semantic.candidates(semantic.unlisted_counts(df, NAMES_CONTRACT, [])).select("column", "value")


@query(
    "normalized_mapping",
    f"WITH {feeds.feed_sql()}, unlisted AS ({_UNLISTED}) SELECT u.col AS \"column\", u.value AS source, t.target, 'deterministic' AS resolver FROM unlisted u JOIN "
    "(VALUES ('f', 'F'), ('o', 'O'), ('p', 'P'), ('filled', 'F'), ('open', 'O'), ('pending', 'P')) AS t(norm, target) "
    "ON t.norm = LOWER(TRIM(regexp_replace(u.value, '\\s+', ' ', 'g'))) WHERE u.value <> t.target",
)
def normalized_mapping(spark, folder):
    found = semantic.candidates(semantic.unlisted_counts(feeds.orders_feed(spark, folder), ORDER_CONTRACT, []))
    return semantic.resolve(found, ORDER_CONTRACT.vocab_table(spark), ORDER_CONTRACT.ambiguity_table(spark))


@query(
    "external_mapping",
    f"WITH {feeds.feed_sql()}, unlisted AS ({_UNLISTED}) SELECT 'status' AS \"column\", value AS source, 'P' AS target, 'external' AS resolver FROM unlisted WHERE value = 'pend?'",
)
def external_mapping(spark, folder):
    """A proposal per status value; only the one that names a candidate and a listed target is usable."""
    feed = feeds.orders_feed(spark, folder)
    found = semantic.candidates(semantic.unlisted_counts(feed, ORDER_CONTRACT, []))
    proposals = feed.select("status").distinct().select(
        F.lit("status").alias("column"), F.col("status").alias("source"),
        F.when(F.col("status") == "pend?", "P").otherwise("unheard of").alias("target"),
        F.lit(True).alias("grounded"), F.lit(False).alias("abstained"),
    )
    return semantic.resolve(found, ORDER_CONTRACT.vocab_table(spark), ORDER_CONTRACT.ambiguity_table(spark), proposals)


@query(
    "candidate_totals",
    f"WITH {feeds.feed_sql()}, unlisted AS ({_UNLISTED}) SELECT col AS \"column\", CAST(SUM(cnt) AS BIGINT) AS candidate_records, "
    "CAST(SUM(cnt) FILTER (WHERE value IN ('f','o','p')) AS BIGINT) AS mapped_records, CAST(SUM(cnt) FILTER (WHERE value NOT IN ('f','o','p')) AS BIGINT) AS unmapped_records FROM unlisted GROUP BY col",
)
def candidate_totals(spark, folder):
    found = semantic.candidates(semantic.unlisted_counts(feeds.orders_feed(spark, folder), ORDER_CONTRACT, []))
    mapping = semantic.resolve(found, ORDER_CONTRACT.vocab_table(spark), ORDER_CONTRACT.ambiguity_table(spark))
    return semantic.totals(found, mapping)


# -- decisions and release -------------------------------------------------------------------
DECIDED = FINDINGS + """, decided AS (SELECT *, CASE WHEN authorization_mode = 'POLICY_AUTHORIZED' THEN NULL
  WHEN allowed_outcomes LIKE '%APPROVE%' THEN 'APPROVE_PROPOSAL' WHEN allowed_outcomes LIKE 'EXCLUDE%' THEN 'EXCLUDE' ELSE 'QUARANTINE' END AS outcome FROM findings),
labelled AS (SELECT *, CASE WHEN outcome IS NULL THEN 'POLICY_ACTION_APPROVED' WHEN outcome = 'APPROVE_PROPOSAL' THEN 'HUMAN_ACTION_APPROVED'
  WHEN outcome = 'EXCLUDE' THEN 'EXCLUDED' ELSE 'QUARANTINED' END AS disposition FROM decided)"""
_QUARANTINE = "SELECT ordinal FROM members WHERE finding_id IN (SELECT finding_id FROM labelled WHERE disposition = 'QUARANTINED')"
APPLIED = DECIDED + f""", edits AS (SELECT f.*,
  CASE WHEN status IN ({listed(ALIASES)}) AND NOT {CONFLICT} THEN CASE status WHEN 'filled' THEN 'F' WHEN 'Filled' THEN 'F' WHEN 'OPEN' THEN 'O' ELSE 'P' END
    WHEN status IN ('f','o','p') AND NOT {CONFLICT} THEN UPPER(status) ELSE status END AS new_status,
  CASE WHEN {ISO_OK} THEN order_date WHEN {DMY_OK} THEN strftime(try_strptime(order_date, '%d/%m/%Y'), '%Y-%m-%d')
    WHEN {YMD_OK} THEN strftime(try_strptime(order_date, '%Y/%m/%d'), '%Y-%m-%d') ELSE order_date END AS new_date,
  CASE WHEN f.ordinal IN ({_QUARANTINE}) THEN 'QUARANTINED' WHEN copy_no > 1 THEN 'EXCLUDED' END AS membership FROM flagged f)"""


@query("default_decisions", DECIDED + " SELECT finding_id, outcome FROM decided WHERE outcome IS NOT NULL")
def default_decisions(spark, folder):
    return decide.default_decisions(analysed(spark, folder).findings).select("finding_id", "outcome")


@query("dispositions", DECIDED + " SELECT finding_id, outcome, disposition FROM labelled")
def dispositions(spark, folder):
    found = analysed(spark, folder).findings
    return decide.dispositions(found, decide.default_decisions(found)).select("finding_id", "outcome", "disposition")


@query("disposition_counts", DECIDED + " SELECT disposition, COUNT(*) AS findings FROM labelled GROUP BY 1")
def disposition_counts(spark, folder):
    found = analysed(spark, folder).findings
    done = decide.dispositions(found, decide.default_decisions(found))
    return done.groupBy("disposition").agg(F.count("*").alias("findings"))


@query(
    "change_actions",
    DECIDED + ", formats AS (SELECT DISTINCT finding_id, detail FROM claims WHERE finding_id LIKE 'FMT-%') SELECT l.finding_id, "
    "CASE disposition WHEN 'QUARANTINED' THEN 'QUARANTINE_RECORDS' WHEN 'EXCLUDED' THEN 'EXCLUDE_COLUMN_FROM_RELEASE' ELSE proposed_action END AS action_type, f.detail AS source_format, "
    "CASE WHEN disposition = 'POLICY_ACTION_APPROVED' THEN 'POLICY' ELSE 'HUMAN' END AS authorization_source, "
    "CASE WHEN disposition = 'POLICY_ACTION_APPROVED' THEN 'orders-feed@1.0.0:' || l.finding_id ELSE 'decision:' || l.finding_id END AS authorization_ref "
    "FROM labelled l LEFT JOIN formats f ON f.finding_id = l.finding_id",
)
def change_actions(spark, folder):
    return decide.action_table(planned(spark, folder).changes, spark).select(
        "finding_id", "action_type", "source_format", "authorization_source", "authorization_ref"
    )


@query(
    "change_set_totals",
    APPLIED + " SELECT COUNT(*) AS records, COUNT(*) FILTER (WHERE membership = 'QUARANTINED') AS quarantined, COUNT(*) FILTER (WHERE membership = 'EXCLUDED') AS excluded, "
    "COUNT(*) FILTER (WHERE membership IS NULL) AS eligible, CAST(SUM(CASE WHEN new_status IS DISTINCT FROM status THEN 1 ELSE 0 END + CASE WHEN new_date IS DISTINCT FROM order_date THEN 1 ELSE 0 END) AS BIGINT) AS changed_cells, "
    "COUNT(*) FILTER (WHERE membership IS NOT NULL OR new_status IS DISTINCT FROM status OR new_date IS DISTINCT FROM order_date) AS affected_records FROM edits",
)
def change_set_totals(spark, folder):
    plan = planned(spark, folder)
    return release.totals(plan.rows, plan.changes, ORDER_CONTRACT, plan.analysis.known).select(
        "records", "quarantined", "excluded", "eligible", "changed_cells", "affected_records"
    )


_REST = ", ".join(n for n in ORDER_NAMES if n not in ("status", "order_date", "clerk_note"))


@query("candidate_table", APPLIED + f" SELECT ordinal, new_status AS status, new_date AS order_date, clerk_note, {_REST} FROM edits")
def candidate_table(spark, folder):
    plan = planned(spark, folder)
    return release.candidate(plan.rows, plan.changes, plan.analysis.known).drop("record_uid")


@query("release_table", APPLIED + f" SELECT ordinal, record_uid, new_status AS status, new_date AS order_date, {_REST} FROM edits WHERE membership IS NULL")
def release_table(spark, folder):
    plan = planned(spark, folder)
    return release.release_table(plan.rows, plan.changes, plan.analysis.known)


@query("release_membership", APPLIED + " SELECT record_uid, membership FROM edits WHERE membership IS NOT NULL")
def release_membership(spark, folder):
    return planned(spark, folder).rows.filter(F.col("membership").isNotNull()).select("record_uid", "membership")


_SOURCE = "CASE WHEN disposition = 'POLICY_ACTION_APPROVED' THEN 'POLICY' ELSE 'HUMAN' END"
_CELLS = f"""cells_changed AS (
  SELECT ordinal, order_id AS display_key, 'status' AS col, status AS before, new_status AS after, 'NORMALIZE_CATEGORY' AS action_type,
    CASE WHEN status IN ({listed(ALIASES)}) THEN 'CAT-status' ELSE 'SEM-status' END AS finding_id FROM edits WHERE new_status IS DISTINCT FROM status
  UNION ALL SELECT ordinal, order_id, 'order_date', order_date, new_date, 'STANDARDIZE_DATE_FORMAT', 'FMT-order_date' FROM edits WHERE new_date IS DISTINCT FROM order_date)"""
_OWNERS = """owners AS (SELECT m.ordinal, FIRST(m.finding_id ORDER BY CASE WHEN m.finding_id LIKE 'DUP%' THEN 0 WHEN m.finding_id LIKE '%CONFLICT' THEN 1 WHEN m.finding_id LIKE 'AMB%' THEN 2 WHEN m.finding_id LIKE 'MISS%' THEN 3 ELSE 4 END,
  CASE split_part(m.finding_id, '-', 2) WHEN 'order_id' THEN 0 WHEN 'invoice' THEN 1 WHEN 'customer' THEN 2 WHEN 'status' THEN 3 WHEN 'phase' THEN 4 WHEN 'total' THEN 5 WHEN 'order_date' THEN 6 WHEN 'priority' THEN 7 WHEN 'clerk_note' THEN 8 WHEN 'booked_at' THEN 9 ELSE 10 END) AS finding_id
  FROM members m JOIN labelled l ON l.finding_id = m.finding_id WHERE l.disposition = 'QUARANTINED' GROUP BY m.ordinal)"""
LEDGER = APPLIED + f", {_CELLS}, {_OWNERS}" + """, memberships AS (
  SELECT e.ordinal, e.order_id AS display_key, CAST(NULL AS VARCHAR) AS col, CAST(NULL AS VARCHAR) AS before, membership AS after,
    CASE membership WHEN 'QUARANTINED' THEN 'QUARANTINE_RECORDS' ELSE 'EXCLUDE_EXACT_DUPLICATE_FROM_RELEASE' END AS action_type,
    CASE membership WHEN 'QUARANTINED' THEN o.finding_id ELSE 'DUP-EXACT' END AS finding_id FROM edits e LEFT JOIN owners o ON o.ordinal = e.ordinal WHERE membership IS NOT NULL),
ledger AS (SELECT * FROM cells_changed UNION ALL SELECT * FROM memberships)"""


@query(
    "change_ledger",
    LEDGER + f' SELECT g.ordinal, g.display_key, g.col AS "column", g.before, g.after, g.action_type, g.finding_id, {_SOURCE} AS authorization_source FROM ledger g JOIN labelled l ON l.finding_id = g.finding_id',
)
def change_ledger(spark, folder):
    plan = planned(spark, folder)
    entries = release.ledger(plan.rows, plan.changes, ORDER_CONTRACT, plan.analysis.known)
    return entries.drop("record_uid", "authorization_ref")


@query(
    "ledger_order",
    LEDGER + " SELECT CASE WHEN col IS NOT NULL THEN 0 WHEN after = 'QUARANTINED' THEN 1 WHEN after = 'EXCLUDED' THEN 2 ELSE 3 END AS ledger_rank, COUNT(*) AS entries, MIN(ordinal) AS first_ordinal, MAX(ordinal) AS last_ordinal FROM ledger GROUP BY 1",
)
def ledger_order(spark, folder):
    plan = planned(spark, folder)
    entries = release.ledger(plan.rows, plan.changes, ORDER_CONTRACT, plan.analysis.known)
    return entries.groupBy(release.ledger_rank().alias("ledger_rank")).agg(
        F.count("*").alias("entries"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal")
    )


@query("change_preview", LEDGER + ' SELECT ordinal, display_key, col AS "column", before, after, finding_id, action_type FROM cells_changed ORDER BY ordinal, col LIMIT 50')
def change_preview(spark, folder):
    plan = planned(spark, folder)
    entries = release.ledger(plan.rows, plan.changes, ORDER_CONTRACT, plan.analysis.known)
    return release.preview(entries).select("ordinal", "display_key", "column", "before", "after", "finding_id", "action_type")


@query(
    "preview_totals",
    DECIDED + ", sized AS (SELECT finding_id, COUNT(*) AS n FROM members GROUP BY 1) SELECT CASE disposition WHEN 'QUARANTINED' THEN 'QUARANTINE_RECORDS' WHEN 'EXCLUDED' THEN 'EXCLUDE_COLUMN_FROM_RELEASE' ELSE proposed_action END AS action_type, "
    "CAST(SUM(CASE WHEN disposition = 'EXCLUDED' THEN 1 ELSE n END) AS BIGINT) AS records FROM labelled JOIN sized USING (finding_id) GROUP BY 1",
)
def preview_totals(spark, folder):
    plan = planned(spark, folder)
    sized = detect.members(plan.analysis.annotated).groupBy("finding_id").agg(F.count("*").alias("records"))
    actions = decide.action_table(plan.changes, spark).select("action_type", "finding_id").distinct()
    return release.preview_totals(sized, actions)


@query("cell_diff", LEDGER + ' SELECT e.record_uid, c.col AS "column", c.before, c.after FROM cells_changed c JOIN edits e ON e.ordinal = c.ordinal')
def cell_diff(spark, folder):
    plan = planned(spark, folder)
    after = release.candidate(plan.rows, plan.changes, plan.analysis.known)
    return release.cell_diff(plan.analysis.source, after, plan.analysis.columns)


@query(
    "unapproved_changes",
    LEDGER + " SELECT c.col AS \"column\", CASE WHEN l.disposition = 'POLICY_ACTION_APPROVED' THEN c.action_type ELSE 'UNAPPROVED' END AS action_type, COUNT(*) AS cells FROM cells_changed c JOIN labelled l ON l.finding_id = c.finding_id GROUP BY 1, 2",
)
def unapproved_changes(spark, folder):
    """Changed cells against policy authorizations only: what a person approved shows up as unapproved."""
    plan = planned(spark, folder)
    known = plan.analysis.known
    after = release.candidate(plan.rows, plan.changes, known)
    changed = release.cell_diff(plan.analysis.source, after, plan.analysis.columns)
    entries = release.ledger(plan.rows, plan.changes, ORDER_CONTRACT, known)
    policy = entries.filter("column IS NOT NULL AND authorization_source = 'POLICY'").select("record_uid", "column", "action_type")
    return release.authorized(changed, policy).groupBy("column", "action_type").agg(F.count("*").alias("cells"))


@query(
    "conflict_cells_unchanged",
    APPLIED + " SELECT COUNT(*) AS members, COUNT(*) FILTER (WHERE new_status IS DISTINCT FROM e.status) AS changed FROM members m JOIN edits e ON e.ordinal = m.ordinal WHERE m.finding_id = 'SEM-status-CONFLICT'",
)
def conflict_cells_unchanged(spark, folder):
    plan = planned(spark, folder)
    after = release.candidate(plan.rows, plan.changes, plan.analysis.known).select("record_uid", F.col("status").alias("new_status"))
    conflict = detect.members(plan.analysis.annotated).filter("finding_id = 'SEM-status-CONFLICT'")
    before = plan.analysis.source.select("record_uid", "status")
    return conflict.join(before, "record_uid").join(after, "record_uid").agg(
        F.count("*").alias("members"), F.count(F.when(~F.col("status").eqNullSafe(F.col("new_status")), 1)).alias("changed")
    )


_COUNTS = """, n AS (SELECT COUNT(*) FILTER (WHERE membership = 'QUARANTINED') AS q, COUNT(*) FILTER (WHERE membership = 'EXCLUDED') AS x, COUNT(*) FILTER (WHERE membership IS NULL) AS r,
  CAST(SUM(CASE WHEN new_status IS DISTINCT FROM status THEN 1 ELSE 0 END + CASE WHEN new_date IS DISTINCT FROM order_date THEN 1 ELSE 0 END) AS BIGINT) AS c FROM edits)"""


@query(
    "release_validations",
    APPLIED + _COUNTS + f""", done AS (SELECT {cell_sum([filled('order_id'), filled('customer')])} AS f FROM feed)
SELECT check_id, TRUE AS passed, observed FROM (
  SELECT 'SOURCE_IMMUTABLE' AS check_id, NULL AS observed UNION ALL SELECT 'SCOPE_STABLE', NULL UNION ALL SELECT 'EVALUATION_SCOPE_STABLE', NULL
  UNION ALL SELECT 'COMPLETENESS_NOT_IMPUTED', CAST(f AS STRING) FROM done UNION ALL SELECT 'NO_UNAPPROVED_CELL_CHANGES', CAST(c AS STRING) FROM n
  UNION ALL SELECT 'CONFLICTS_UNCHANGED', '0' UNION ALL SELECT 'QUARANTINE_EXCLUDED', CAST(q AS STRING) FROM n UNION ALL SELECT 'DUPLICATES_EXCLUDED', CAST(x AS STRING) FROM n
  UNION ALL SELECT 'SENSITIVE_COLUMN_EXCLUDED', NULL UNION ALL SELECT 'ROW_RECONCILIATION', CAST(r AS STRING) FROM n UNION ALL SELECT 'FINDING_CONSERVATION', NULL
  UNION ALL SELECT 'ACTION_SET_HASH_MATCH', NULL UNION ALL SELECT 'CHANGE_LEDGER_RECONCILES', '{{"cells":' || c || ',"memberships":' || (q + x) || '}}' FROM n UNION ALL SELECT 'MANIFEST_HASHES_RECOMPUTED', NULL)""",
)
def release_validations(spark, folder):
    """The 14 checks; the observed value is shown where it is a count."""
    checks = executed(spark, folder).validations()
    counted = F.col("observed").rlike(r'^[0-9]+$|^\{"cells"')
    return checks.select("check_id", "passed", F.when(counted, F.col("observed")).alias("observed"))


_DONE = "SELECT {0} AS altered, {1} AS imputed, CAST({2} AS BIGINT) AS unapproved, CAST({3} AS BIGINT) AS conflicts_changed FROM {4}"
_EMPTY = f"COUNT(*) FILTER (WHERE {sqltext.blank('customer')})"


@query(
    "candidate_corruption",
    APPLIED + " " + " UNION ALL ".join([
        _DONE.format("'nothing'", "0", "0", "0", "(SELECT 1)"),
        _DONE.format("'phase'", "0", "COUNT(*) FILTER (WHERE UPPER(phase) <> phase)", "0", "feed"),
        _DONE.format("'customer'", _EMPTY, _EMPTY, "0", "feed"),
        _DONE.format(
            "'status'", "0", "COUNT(*) FILTER (WHERE status IS NOT NULL AND new_status IS NOT DISTINCT FROM status)",
            "(SELECT COUNT(*) FROM members m JOIN edits e ON e.ordinal = m.ordinal WHERE m.finding_id = 'SEM-status-CONFLICT' AND e.status IS NOT NULL)", "edits",
        ),
    ]),
)
def candidate_corruption(spark, folder):
    """What the comparison of source and stored candidate reports when one column of it was altered after the fact."""
    plan = planned(spark, folder)
    known, contract, rows = plan.analysis.known, plan.analysis.contract, plan.rows
    candidate = release.candidate(rows, plan.changes, known)
    altered = {
        "nothing": candidate,
        "phase": candidate.withColumn("phase", F.upper("phase")),
        "customer": candidate.withColumn("customer", F.when(is_blank(F.col("customer")), "imputed").otherwise(F.col("customer"))),
        "status": candidate.withColumn("status", F.concat("status", F.lit("!"))),
    }
    out = None
    for name, stored in altered.items():
        part = release.reconciliation(rows, stored, plan.changes, contract, known).select(
            F.lit(name).alias("altered"), (F.col("filled_after") - F.lit(plan.totals["filled_before"])).alias("imputed"),
            F.col("unapproved_cells").alias("unapproved"), "conflicts_changed",
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "release_manifest",
    APPLIED + _COUNTS + " SELECT r + q + x AS total_source_records, r AS eligible_record_count, q AS quarantined_record_count, x AS excluded_record_count, CAST(0 AS BIGINT) AS flagged_record_count, "
    "'clerk_note' AS excluded_columns, CAST(14 AS BIGINT) AS validations_passed, CAST(0 AS BIGINT) AS validations_failed, 'CONDITIONAL_PASS' AS release_status, "
    f"'{ORDER_CONTRACT.hash}' AS contract_hash FROM n",
)
def release_manifest(spark, folder):
    return executed(spark, folder).manifest().select(
        "total_source_records", "eligible_record_count", "quarantined_record_count", "excluded_record_count", "flagged_record_count",
        "excluded_columns", "validations_passed", "validations_failed", "release_status", "contract_hash",
    )


_CHECKS = ", ".join(
    f"('{c}', TRUE)" for c in (
        "SOURCE_HASH", "CONTRACT_HASH", "ACTION_SET_HASH", "DECISION_SET_HASH", "CANDIDATE_HASH", "RELEASE_HASH", "CHANGES_HASH",
        "REEXECUTION_RELEASE_HASH", "REEXECUTION_VALIDATIONS",
    )
)


@query("run_verification", f"SELECT * FROM (VALUES {_CHECKS}) AS c(check_id, passed)")
def run_verification(spark, folder):
    with lean_shuffles(spark):
        outcome = executed(spark, folder)
        plan = outcome.plan
        decisions = decide.default_decisions(plan.analysis.findings)
        rows = gate.verify(outcome, plan.analysis.source, decisions, gate.stored_hashes(outcome))
    return spark.createDataFrame([(c, p) for c, p, _, _ in rows], "check_id string, passed boolean")


@query("tamper_check", "SELECT 'SOURCE_IMMUTABLE' AS check_id, FALSE AS passed")
def tamper_check(spark, folder):
    """Execute the approved change set on a source in which one column was altered."""
    plan = planned(spark, folder)
    changed = plan.analysis.source.withColumn("phase", F.upper("phase"))
    checks = gate.execute(plan, changed).validations()
    return checks.filter("check_id = 'SOURCE_IMMUTABLE'").select("check_id", "passed")


@query(
    "candidate_metrics",
    APPLIED + f" SELECT 'consistency' AS metric, CAST(SUM(CASE WHEN {filled('new_status')} AND new_status IN ({listed(VOCABULARY)}) THEN 1 ELSE 0 END + CASE WHEN priority IN ({listed(feeds.PRIORITIES)}) THEN 1 ELSE 0 END) AS BIGINT) AS numerator FROM edits "
    f"UNION ALL SELECT 'completeness', {cell_sum([filled('order_id'), filled('customer')])} FROM edits",
)
def candidate_metrics(spark, folder):
    outcome = executed(spark, folder)
    return gate.candidate_metrics(outcome).filter("metric IN ('consistency', 'completeness')").select("metric", "numerator")


_SCORE = "CAST(ROUND(100.0::DOUBLE * {0} / {1}, 2) AS VARCHAR)"
_FACTS = {
    "record_count": "(SELECT COUNT(*) FROM feed)", "column_count": str(len(ORDER_NAMES)), "finding_total": "(SELECT COUNT(*) FROM findings)",
    **{f"finding_{r.lower()}": f"(SELECT COUNT(*) FROM findings WHERE risk_level = '{r}')" for r in ("HIGH", "MEDIUM", "LOW")},
    "blocking_open": "(SELECT COUNT(*) FROM findings WHERE blocking)", "contract_id": "'orders-feed'", "contract_version": "'1.0.0'",
    "release_status": "(SELECT CASE WHEN q + x = 0 THEN 'PASS' ELSE 'CONDITIONAL_PASS' END FROM n)", "eligible_record_count": "(SELECT r FROM n)", "quarantined_record_count": "(SELECT q FROM n)",
    "excluded_record_count": "(SELECT x FROM n)", "flagged_record_count": "(SELECT COUNT(*) FROM edits WHERE membership = 'FLAGGED')", "excluded_column_count": "1",
    "validations_passed": "14", "validations_total": "14", "ai_call_count": "0",
    **{f"metric_{m}": f"(SELECT {_SCORE.format('numerator', 'denominator')} FROM scored WHERE metric = '{m}')" for m in ("completeness", "validity", "consistency", "uniqueness")},
    "candidate_metric_uniqueness": f"(SELECT {_SCORE.format('numerator', 'denominator')} FROM scored WHERE metric = 'uniqueness')",
}


@query(
    "release_facts",
    APPLIED + _COUNTS + METRICS.removeprefix(BASE) + " " + " UNION ALL ".join(f"SELECT '{k}' AS fact_id, CAST({v} AS VARCHAR) AS value" for k, v in _FACTS.items()),
)
def release_facts(spark, folder):
    """The named facts of an executed run; scores that SQL doesn't work out here are left to the tests."""
    outcome = executed(spark, folder)
    return gate.release_facts(outcome.plan.analysis, outcome, 0).filter(F.col("fact_id").isin(*_FACTS))


_AFTER = {name: {"status": "new_status", "order_date": "new_date"}.get(name, name) for name in ORDER_NAMES}


def edited_facts_sql(where: str) -> str:
    """Facts of the edited columns and all others over the edited rows."""
    relation = APPLIED.removeprefix("WITH ") + ", after AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _AFTER.items()) + f" FROM edits{where})"
    return sqltext.facts_sql("after", {name: name for name in ORDER_NAMES}, relation) + f""" SELECT f.col AS "column", f.row_count, f.empty, f.n AS non_empty, f.distinct_count, f.max_length,
  v.inferred_type, v.type_match, {sqltext.edge('min')} AS min_value, {sqltext.edge('max')} AS max_value, f.sensitive_hits
  FROM filled f JOIN vote v ON v.col = f.col LEFT JOIN edges e ON e.col = f.col"""


def edited_facts(spark, folder, released):
    outcome = executed(spark, folder)
    counts = once(spark, folder, "source-counts", lambda: gate.profiled(outcome.plan.analysis.source)[0])
    return profile.column_facts(gate.edited_counts(outcome, counts, released=released)).select(
        "column", "row_count", "empty", "non_empty", "distinct_count", F.col("max_length").cast("bigint").alias("max_length"),
        "inferred_type", "type_match", "min_value", "max_value", "sensitive_hits",
    )


@query("candidate_facts", edited_facts_sql(""))
def candidate_facts(spark, folder):
    """Column facts of the candidate from the source's value counts and the ledger."""
    return edited_facts(spark, folder, False)


@query("released_facts", edited_facts_sql(" WHERE membership IS NULL"))
def released_facts(spark, folder):
    """Column facts of the released records: removed ones are taken away from the counts."""
    return edited_facts(spark, folder, True)


SEGMENTS = Contract.from_dict({"id": "segments", "version": "1", "fields": {"c_mktsegment": {"allowed": ["BUILDING", "Machinery "], "semantic": True}}})


@query(
    "semantic_spellings",
    """SELECT 'SEM-c_mktsegment' AS finding_id, 'NORMALIZE_CATEGORY' AS proposed_action, 'machinery' AS part, COUNT(*) AS affected_record_count FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT 'SEM-c_mktsegment', NULL, 'unmapped', COUNT(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
)
def semantic_spellings(spark, folder):
    """Segments outside the vocabulary: one that a normalized match maps, and, where that one is spelled right, those that nothing maps."""
    rows = with_identity(stringify(read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment")), "customer", "c_custkey")
    parts = {"machinery": rows, "unmapped": rows.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "MACHINERY", "BUILDING").otherwise(F.col("c_mktsegment")))}
    out = None
    for name, source in parts.items():
        found = gate.analyse(written(source, "customers"), SEGMENTS).findings.filter("finding_id = 'SEM-c_mktsegment'")
        row = found.select("finding_id", "proposed_action", F.lit(name).alias("part"), "affected_record_count")
        out = row if out is None else out.unionByName(row)
    return out


# -- redaction and drafting ------------------------------------------------------------------
def feed_profile(spark, folder):
    source = feeds.orders_feed(spark, folder)
    counts, facts = gate.profiled(source)
    return profile.column_profile(source, counts, facts, ORDER_CONTRACT), facts


@query(
    "heuristic_sensitive_columns",
    f"WITH {sqltext.counts_sql('customer')} SELECT DISTINCT col AS \"column\" FROM counts WHERE cls IS NOT NULL OR "
    + " OR ".join(f"LOWER(col) LIKE '%{t}%'" for t in patterns.SENSITIVE_NAME_TOKENS),
)
def heuristic_sensitive_columns(spark, folder):
    from sluice.sources.tables import read_table, stringify

    df = stringify(read_table(spark, folder, "customer"))
    counts, facts = gate.profiled(df)
    return ground.heuristic_sensitive(profile.column_profile(df, counts, facts, Contract()))


_TOPS = sqltext.facts_sql("feed", {n: n for n in ORDER_NAMES}, feeds.feed_sql()) + (
    ", ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank FROM counts WHERE NOT blank), "
    "hidden AS (SELECT DISTINCT col FROM counts WHERE cls IS NOT NULL UNION SELECT 'clerk_note')"
)


@query("observed_values", _TOPS + ' SELECT DISTINCT col AS "column", SUBSTR(value, 1, 64) AS value FROM ranked WHERE rank <= 5 AND col NOT IN (SELECT col FROM hidden)')
def observed_values(spark, folder):
    return ground.observed_values(feed_profile(spark, folder)[0])


@query(
    "redacted_profile",
    _TOPS + ", shown AS (SELECT col, COUNT(*) AS top_shown FROM ranked WHERE rank <= 5 AND col NOT IN (SELECT col FROM hidden) GROUP BY col) "
    'SELECT f.col AS "column", f.distinct_count, f.sensitive_hits AS sensitive_hit_count, f.col IN (SELECT col FROM hidden) AS values_withheld, COALESCE(top_shown, 0) AS top_shown '
    "FROM filled f LEFT JOIN shown s ON s.col = f.col",
)
def redacted_profile(spark, folder):
    shown = ground.redacted_profile(feed_profile(spark, folder)[0])
    return shown.select(
        "column", "distinct_count", "sensitive_hit_count", "values_withheld", F.size("top_values").cast("bigint").alias("top_shown")
    )


@query(
    "redacted_candidates",
    "SELECT 'props' AS \"column\", props AS value, cnt FROM (SELECT props, COUNT(*) AS cnt FROM events WHERE LENGTH(props) <= 64 GROUP BY props ORDER BY cnt DESC, props LIMIT 30)",
)
def redacted_candidates(spark, folder):
    from sluice.sources.tables import read_table, stringify

    df = stringify(read_table(spark, folder, "events"))
    counts = profile.value_counts(df.select("props"), ["props"]).filter("NOT blank")
    return ground.redacted_candidates(counts).select("column", "value", "cnt")


def draft_sql(table):
    hints = " OR ".join(f"LOWER(f.col) LIKE '%{t}%'" for t in patterns.SENSITIVE_NAME_TOKENS)
    return sqltext.facts_sql(table) + f""", s AS (SELECT f.*, v.inferred_type, (f.sensitive_hits > 0 OR {hints}) AS sensitive FROM filled f JOIN vote v ON v.col = f.col),
vals AS (SELECT col, STRING_AGG(value, '; ' ORDER BY cnt DESC, value) AS listed FROM counts WHERE NOT blank GROUP BY col)
SELECT s.col AS "column", s.empty = 0 AND s.inferred_type <> 'empty' AS required, s.row_count > 1 AND s.distinct_count = s.n AND s.distinct_count > 1 AS "unique",
  CASE WHEN s.inferred_type NOT IN ('string','empty') THEN s.inferred_type END AS "type", s.sensitive,
  CASE WHEN NOT s.sensitive AND s.inferred_type = 'string' AND s.distinct_count BETWEEN 2 AND 5 THEN vals.listed ELSE '' END AS allowed
FROM s LEFT JOIN vals ON vals.col = s.col"""


def drafted(spark, folder, table):
    from sluice.sources.tables import read_table, stringify

    df = stringify(read_table(spark, folder, table))
    counts, facts = gate.profiled(df)
    shown = profile.column_profile(df, counts, facts, Contract())
    return ground.draft_fields(shown, ground.observed_formats(facts)), shown, df.columns


def contract_draft_query(table):
    def run(spark, folder):
        fields = drafted(spark, folder, table)[0]
        return fields.select("column", "required", "unique", "type", "sensitive", F.array_join("allowed", "; ").alias("allowed"))

    query(f"contract_draft_{table}", draft_sql(table))(run)


for _table in ("customer", "part", "orders"):
    contract_draft_query(_table)


@query("draft_business_key", "SELECT 'event_id' AS \"column\" WHERE (SELECT COUNT(DISTINCT event_id) = COUNT(*) FROM events)")
def draft_business_key(spark, folder):
    fields, _, order = drafted(spark, folder, "events")
    return ground.draft_business_key(fields, order)


@query(
    "draft_canonical",
    f"WITH {feeds.feed_sql()}, tops AS (SELECT express AS value, COUNT(*) AS cnt FROM (SELECT CASE WHEN express = 'No' AND EXTRACT(DAY FROM TRY_CAST(SUBSTR(booked_at, 1, 10) AS DATE)) < 9 THEN 'NO ' WHEN express = 'No' THEN 'no' ELSE 'later ' || express END AS express FROM feed) GROUP BY 1 ORDER BY cnt DESC, value LIMIT 5), "
    "spelled AS (SELECT *, LOWER(TRIM(value)) AS norm, ROW_NUMBER() OVER (PARTITION BY LOWER(TRIM(value)) ORDER BY cnt DESC, value) AS rank FROM tops) "
    "SELECT 'express' AS \"column\", t.value AS target, s.value AS alias FROM spelled s JOIN spelled t ON t.norm = s.norm AND t.rank = 1 WHERE s.rank > 1",
)
def draft_canonical(spark, folder):
    feed = feeds.orders_feed(spark, folder)
    day = F.substring("booked_at", 9, 2).try_cast("int")
    spelled = F.when((F.col("express") == "No") & (day < 9), "NO ").when(F.col("express") == "No", "no").otherwise(F.concat(F.lit("later "), "express"))
    df = feed.select(spelled.alias("express"))
    counts, facts = gate.profiled(df)
    return ground.draft_canonical(profile.column_profile(df, counts, facts, Contract()))
