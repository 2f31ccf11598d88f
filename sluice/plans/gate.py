"""The gate end to end: analyse, decide, release, reconcile, verify."""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sluice.contract import Contract, canonical_json
from sluice.functions.hashing import fingerprint
from sluice.operators import decide, detect, groups, metrics, profile, release, runs
from sluice.operators.decide import ChangeSet, GovernanceError
from sluice.operators.detect import Knowledge
from sluice.session import lean_shuffles, scratch, together, written

CHECK_SCHEMA = "check_rank int, check_id string, passed boolean, observed string, expected string"


@dataclass
class Analysis:
    source: DataFrame
    contract: Contract
    known: Knowledge
    annotated: DataFrame
    distinct: DataFrame
    findings: DataFrame
    metrics: DataFrame
    totals: DataFrame
    settled: bool = False

    @property
    def columns(self) -> list[str]:
        return self.known.columns


def analyse(
    source: DataFrame,
    contract: Contract | None = None,
    *,
    facts: DataFrame | None = None,
    proposals: DataFrame | None = None,
) -> Analysis:
    """Detect and score a table of text columns with ``ordinal`` and ``record_uid``."""
    active = contract or Contract()
    columns = detect.data_columns(source)

    def learned() -> tuple[DataFrame | None, Knowledge]:
        seen = profiled(source)[1] if active.observational and facts is None else facts
        return seen, detect.learn(source, active, seen, proposals)

    (facts, known), (marked, distinct) = together(learned, lambda: detect.group_marks(source, active, columns))
    annotated = detect.annotate(source, active, known, marked)
    has_key = not active.observational and "business_key" in distinct.columns
    totals = groups.group_totals(distinct, "business_key" if has_key else None)
    sums = metrics.observed_sums(facts) if active.observational else metrics.metric_sums(source, active, known)
    found = detect.findings(annotated, active, known)
    return Analysis(source, active, known, annotated, distinct, found, metrics.metrics(sums, totals), totals)


def settled(analysis: Analysis) -> Analysis:
    """The analysis over annotated rows that are written once; findings and what follows from them read those.

    Reading a column of the written table is cheaper than matching the rules once more.
    """
    if analysis.settled:
        return analysis
    annotated = written(analysis.annotated, "annotated")
    found = written(detect.findings(annotated, analysis.contract, analysis.known), "findings")
    return replace(analysis, annotated=annotated, findings=found, settled=True)


def profiled(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value counts, column facts); the counts are written once because several reports read them."""
    counts = written(profile.cell_counts(source, detect.data_columns(source)), "counts")
    return counts, written(profile.column_facts(counts), "facts")


def column_profile(analysis: Analysis) -> DataFrame:
    counts, facts = profiled(analysis.source)
    return profile.column_profile(analysis.source, counts, facts, analysis.contract)


def sealed(df: DataFrame, columns: list[str]) -> Row:
    """(members, fingerprint) of a table's content; one row."""
    return release.table_fingerprint(df, columns).first() or Row(members=0, fingerprint=hashlib.sha256(b"").hexdigest())


def scope(df: DataFrame) -> Row:
    return release.scope_fingerprint(df).first() or Row(members=0, fingerprint=hashlib.sha256(b"").hexdigest())


def digest_of(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def evaluation_hash(scope_hash: str, contract: Contract, columns: list[str]) -> str:
    fields = columns if contract.observational else [c for c in columns if c in contract.fields]
    return digest_of(
        {
            "scope": scope_hash,
            "fields": sorted(fields),
            "business_key": contract.business_key,
            "contract_hash": contract.hash,
            "score_version": contract.score_version,
        }
    )


def action_prints(annotated: DataFrame) -> dict[str, str]:
    """Order-free fingerprint of the members of every finding and detail; bounded by the findings."""
    rows = fingerprint(annotated.select(F.inline("claims"), "record_uid"), "record_uid", ["finding_id", "detail"]).collect()
    return {f"{r['finding_id']}|{r['detail']}": r["fingerprint"] for r in rows}


def action_set_hash(changes: ChangeSet, prints: dict[str, str]) -> str:
    def entry(action: decide.Action) -> dict[str, Any]:
        own = {k: v for k, v in prints.items() if k.split("|", 1)[0] == action.finding_id}
        return {**vars(action), "members": own}

    return digest_of([entry(action) for action in changes.actions])


def decision_set_hash(decisions: DataFrame) -> str:
    rows = decisions.select("finding_id", "outcome", "run_revision").orderBy("finding_id").collect()
    return digest_of([row.asDict() for row in rows])


@dataclass
class DryRun:
    analysis: Analysis
    changes: ChangeSet
    source_print: str
    scope_print: str
    evaluation: str
    action_hash: str
    decision_hash: str
    totals: dict[str, int]
    conflict_members: int

    @property
    def rows(self) -> DataFrame:
        return release.applied(self.analysis.annotated, self.changes, self.analysis.known)


def dry_run(analysis: Analysis, decisions: DataFrame, revision: int = 1) -> DryRun:
    """Turn decisions into a hashed change set with its totals; nothing is applied.

    Totals, outputs, ledger and checks all read the annotated rows that ``settled`` wrote.
    """
    analysis, decisions, seal, seen_scope = together(
        lambda given=analysis: settled(given),
        lambda given=decisions: written(given, "decisions"),
        lambda: sealed(analysis.source, ["record_uid", *analysis.columns])["fingerprint"],
        lambda: scope(analysis.source)["fingerprint"],
    )
    annotated, found = analysis.annotated, analysis.findings
    claim_counts = written(detect.claim_counts(annotated), "claim-counts")
    changes, prints, decided, conflicts = together(
        lambda: decide.change_set(found, decisions, analysis.contract, analysis.known, claim_counts, revision),
        lambda: action_prints(annotated),
        lambda: decision_set_hash(decisions),
        lambda: claim_counts.filter(F.col("finding_id").endswith("-CONFLICT")).agg(F.sum("records")).first()[0],
    )
    rows = release.applied(annotated, changes, analysis.known)
    totals = release.totals(rows, changes, analysis.contract, analysis.known).first().asDict()
    evaluated = evaluation_hash(seen_scope, analysis.contract, analysis.columns)
    return DryRun(
        analysis, changes, seal, seen_scope, evaluated, action_set_hash(changes, prints), decided, totals, int(conflicts or 0)
    )


@dataclass
class Release:
    plan: DryRun
    candidate: DataFrame
    table: DataFrame
    ledger: DataFrame
    checks: list[tuple[str, bool, Any, Any]]
    status: str
    prints: dict[str, str]

    def validations(self) -> DataFrame:
        rows = [(i, c, p, canonical_json(o), canonical_json(e)) for i, (c, p, o, e) in enumerate(self.checks)]
        return self.table.sparkSession.createDataFrame(rows, CHECK_SCHEMA)

    def manifest(self) -> DataFrame:
        plan, contract = self.plan, self.plan.analysis.contract
        passed = sum(1 for check in self.checks if check[1])
        outcomes: dict[str, int] = {}
        for label in plan.changes.dispositions.values():
            outcomes[label] = outcomes.get(label, 0) + 1
        values = {
            "source_hash": plan.source_print,
            "candidate_hash": self.prints["candidate"],
            "release_hash": self.prints["release"],
            "change_ledger_hash": self.prints["ledger"],
            "contract_hash": contract.hash,
            "score_version": contract.score_version,
            "scope_hash": plan.scope_print,
            "decision_set_hash": plan.decision_hash,
            "action_set_hash": plan.action_hash,
            "total_source_records": plan.totals["records"],
            "eligible_record_count": plan.totals["eligible"],
            "quarantined_record_count": plan.totals["quarantined"],
            "excluded_record_count": plan.totals["excluded"],
            "flagged_record_count": plan.totals["flagged"],
            "excluded_columns": ",".join(plan.changes.excluded_columns),
            "finding_outcome_counts": canonical_json(outcomes),
            "validations_passed": passed,
            "validations_failed": len(self.checks) - passed,
            "release_status": self.status,
        }
        return self.table.sparkSession.createDataFrame([Row(**values)])

    def membership(self) -> DataFrame:
        """(record_uid, membership) instead of uid lists inside the manifest."""
        return self.plan.rows.filter(F.col("membership").isNotNull()).select("record_uid", "membership")


LEDGER_COLUMNS = [
    "record_uid", "display_key", "column", "before", "after", "action_type", "finding_id",
    "authorization_source", "authorization_ref",
]


def execute(plan: DryRun, source: DataFrame | None = None) -> Release:
    """Apply to ``source`` (by default the analysed one), write the outputs, re-read and reconcile them."""
    analysis = plan.analysis
    known, contract, changes = analysis.known, analysis.contract, plan.changes
    current = source if source is not None else analysis.source
    rows = plan.rows
    if source is not None:
        if detect.data_columns(source) != known.columns:
            raise GovernanceError("SOURCE_ARTIFACT_CHANGED", detect.data_columns(source), known.columns)
        # Met once by ordinal and written: outputs, totals and checks all read this table.
        claims = analysis.annotated.select("ordinal", "claims", F.col("record_uid").alias("seen_uid"))
        met = written(source.join(claims, "ordinal", "left").withColumn("claims", F.coalesce("claims", F.array().cast(detect.CLAIM_SCHEMA))), "met")
        unseen = met.filter(~F.coalesce(F.col("record_uid") == F.col("seen_uid"), F.lit(False))).select("record_uid")
        foreign = unseen.join(analysis.annotated.select("record_uid"), "record_uid", "left_anti").limit(5).collect()
        if foreign:  # records that the approved findings never saw
            raise GovernanceError("FOREIGN_RECORDS", [row["record_uid"] for row in foreign], [])
        rows = release.applied(met.drop("seen_uid"), changes, known)
    whole = ["record_uid", *known.columns]
    kept = ["record_uid", *[c for c in known.columns if c not in changes.excluded_columns]]
    now_scope = scope(current)
    if now_scope["members"] != plan.totals["records"]:
        raise GovernanceError("SOURCE_ARTIFACT_CHANGED", now_scope["members"], plan.totals["records"])
    made = {
        "candidate": (release.candidate(rows, changes, known), whole),
        "release": (release.release_table(rows, changes, known), kept),
        "ledger": (release.ledger(rows, changes, contract, known), LEDGER_COLUMNS),
    }
    candidate, table, entries = together(*[lambda n=name, d=df: written(d, n) for name, (df, _) in made.items()])
    removed = rows.filter(release.is_removed()).select("record_uid", "membership")
    still_there = removed.join(table.select("record_uid"), "record_uid", "left_semi").groupBy("membership")
    entry_kind = F.when(F.col("column").isNotNull(), "cells").otherwise("memberships").alias("kind")
    # The written outputs are read back; computed once more they must seal to the same fingerprints.
    (
        seal, stored_candidate, stored_release, stored_ledger, again_candidate, again_release, again_ledger,
        seen, kept_cells, leaked_rows, listed_rows, released, scope_hash, prints_now,
    ) = together(
        lambda: sealed(current, whole)["fingerprint"],
        lambda: sealed(candidate, whole)["fingerprint"],
        lambda: sealed(table, kept)["fingerprint"],
        lambda: sealed(entries, LEDGER_COLUMNS)["fingerprint"],
        *[lambda d=df, c=columns: sealed(d, c)["fingerprint"] for df, columns in made.values()],
        lambda: release.totals(rows, changes, contract, known).first().asDict(),
        lambda: release.reconciliation(rows, candidate, changes, contract, known).first().asDict(),
        lambda: still_there.agg(F.count("*").alias("n")).collect(),
        lambda: entries.groupBy(entry_kind).agg(F.count("*").alias("n")).collect(),
        lambda: table.count(),
        lambda: scope(candidate)["fingerprint"],
        lambda: action_prints(analysis.annotated),
    )
    prints = {"candidate": stored_candidate, "release": stored_release, "ledger": stored_ledger}
    again = {"candidate": again_candidate, "release": again_release, "ledger": again_ledger}
    leaked = {row["membership"]: row["n"] for row in leaked_rows}
    listed = {row["kind"]: row["n"] for row in listed_rows}
    found_ids = {row["finding_id"] for row in analysis.findings.select("finding_id").collect()}
    memberships = seen["planned_quarantined"] + seen["planned_excluded"] + seen["planned_flagged"]
    ledger_seen = {"cells": listed.get("cells", 0), "memberships": listed.get("memberships", 0)}
    ledger_due = {"cells": plan.totals["scoped_cells"], "memberships": memberships}
    actions_now = action_set_hash(changes, prints_now)
    evaluated = evaluation_hash(scope_hash, contract, known.columns)

    def check(name: str, observed: Any, expected: Any, extra: bool = True) -> tuple[str, bool, Any, Any]:
        return (name, observed == expected and extra, observed, expected)

    checks = [
        check("SOURCE_IMMUTABLE", seal, plan.source_print),
        check("SCOPE_STABLE", scope_hash, plan.scope_print),
        check("EVALUATION_SCOPE_STABLE", evaluated, plan.evaluation),
        check("COMPLETENESS_NOT_IMPUTED", kept_cells["filled_after"], plan.totals["filled_before"]),
        check("NO_UNAPPROVED_CELL_CHANGES", kept_cells["changed_cells"], kept_cells["scoped_cells"], kept_cells["unapproved_cells"] == 0),
        check("CONFLICTS_UNCHANGED", kept_cells["conflicts_changed"], 0),
        check("QUARANTINE_EXCLUDED", seen["quarantined"], plan.totals["planned_quarantined"], not leaked.get("QUARANTINED")),
        check("DUPLICATES_EXCLUDED", seen["excluded"], plan.totals["planned_excluded"], not leaked.get("EXCLUDED")),
        check("SENSITIVE_COLUMN_EXCLUDED", [c for c in changes.excluded_columns if c in table.columns], []),
        check("ROW_RECONCILIATION", released, plan.totals["eligible"], released + seen["quarantined"] + seen["excluded"] == plan.totals["records"]),
        check("FINDING_CONSERVATION", sorted(changes.dispositions), sorted(found_ids)),
        check("ACTION_SET_HASH_MATCH", actions_now, plan.action_hash),
        check("CHANGE_LEDGER_RECONCILES", ledger_seen, ledger_due),
        check("MANIFEST_HASHES_RECOMPUTED", prints, again),
    ]
    failed = any(not passed for _, passed, _, _ in checks)
    if failed or changes.blocking_unresolved:
        status = "BLOCKED"
    elif seen["quarantined"] + seen["excluded"] == 0 and not changes.excluded_columns:
        status = "PASS"
    else:
        status = "CONDITIONAL_PASS"
    return Release(plan, candidate, table, entries, checks, status, prints)


def candidate_metrics(outcome: Release) -> DataFrame:
    """Metrics of the candidate; uniqueness stays that of the source."""
    analysis = outcome.plan.analysis
    known = analysis.known
    if analysis.contract.observational:
        sums = metrics.observed_sums(profiled(outcome.candidate)[1])
    else:
        sums = metrics.metric_sums(outcome.candidate, analysis.contract, known)
    return metrics.metrics(sums, analysis.totals)


def edited_counts(outcome: Release, counts: DataFrame, *, released: bool = False) -> DataFrame:
    """Value counts of the candidate, or of the released records, from the source's ``counts`` and what was changed.

    The ledger tells what to move, applied rows only where it masks cells or records were removed; the outputs aren't read.
    """
    plan = outcome.plan
    known, changes = plan.analysis.known, plan.changes
    hidden = known.withheld(plan.analysis.contract)
    masked = [name for name in release.edited_columns(changes) if name in hidden]
    entries = outcome.ledger
    moves = release.ledger_moves(entries.filter(~F.col("column").isin(masked)) if masked else entries)
    if masked:
        moves = moves.unionByName(release.masked_moves(plan.rows, changes, masked))
    if released:
        moves = moves.unionByName(release.removal_moves(plan.rows, changes, known))
    return written(profile.moved_counts(counts, moves), "moved-counts")


def candidate_profile(outcome: Release, counts: DataFrame) -> DataFrame:
    """Full column profile of the candidate without profiling it again."""
    after = edited_counts(outcome, counts)
    return profile.column_profile(outcome.candidate, after, written(profile.column_facts(after), "facts"), outcome.plan.analysis.contract)


def release_facts(analysis: Analysis, outcome: Release | None = None, call_count: int | None = None) -> DataFrame:
    """(fact_id, value): counts, statuses, identifiers and scores of a run as text, never a value of the data; null where a metric doesn't apply."""
    contract = analysis.contract
    spark = analysis.source.sparkSession

    def risk(level: str) -> Column:
        return F.count_if(F.col("risk_level") == level)

    def scores(scored: DataFrame, prefix: str) -> list[DataFrame]:
        each = scored.select(F.concat(F.lit(f"{prefix}metric_"), "metric").alias("fact_id"), F.when(F.col("applicable"), F.col("score")).cast("string").alias("value"))
        return [each, runs.named_facts(metrics.overall_score(scored, contract).withColumnRenamed("overall_score", f"{prefix}overall_score"))]

    found = analysis.findings.agg(
        F.count("*").alias("finding_total"), risk("HIGH").alias("finding_high"), risk("MEDIUM").alias("finding_medium"), risk("LOW").alias("finding_low"),
        F.count_if("blocking").alias("blocking_open"),
    )
    fixed = {"contract_id": contract.id, "contract_version": contract.version, "column_count": len(analysis.columns)}
    parts = [
        runs.named_facts(analysis.source.agg(F.count("*").alias("record_count"))), runs.named_facts(found), *scores(analysis.metrics, ""),
    ]
    if call_count is not None:
        fixed["ai_call_count"] = call_count
    if outcome is None:
        parts.append(runs.named_facts(detect.initial_status(analysis.findings, contract).select("release_status")))
    else:
        totals = outcome.plan.totals
        fixed |= {"release_status": outcome.status, "eligible_record_count": totals["eligible"], "excluded_column_count": len(outcome.plan.changes.excluded_columns)}
        fixed |= {f"{kind}_record_count": totals[kind] for kind in ("quarantined", "excluded", "flagged")}
        fixed |= {"validations_passed": sum(c[1] for c in outcome.checks), "validations_total": len(outcome.checks)}
        parts += scores(candidate_metrics(outcome), "candidate_")
    parts.append(spark.createDataFrame([(k, str(v)) for k, v in fixed.items()], "fact_id string, value string"))
    return functools.reduce(DataFrame.unionByName, parts)


def verify(outcome: Release, source: DataFrame, decisions: DataFrame, stored: dict[str, str]) -> list[tuple[str, bool, Any, Any]]:
    """Recompute every fingerprint of a finished run and execute it again.

    ``stored`` holds what the manifest recorded: source, contract, actions, decisions and outputs.
    """
    plan = outcome.plan
    analysis = plan.analysis
    kept = [c for c in analysis.columns if c in outcome.table.columns]
    actions, decided, seal, candidate, table, entries = together(
        lambda: action_set_hash(plan.changes, action_prints(analysis.annotated)),
        lambda: decision_set_hash(decisions),
        lambda: sealed(source, ["record_uid", *analysis.columns])["fingerprint"],
        lambda: sealed(outcome.candidate, ["record_uid", *analysis.columns])["fingerprint"],
        lambda: sealed(outcome.table, ["record_uid", *kept])["fingerprint"],
        lambda: sealed(outcome.ledger, LEDGER_COLUMNS)["fingerprint"],
    )
    observed = {
        "SOURCE_HASH": seal, "CONTRACT_HASH": analysis.contract.hash, "ACTION_SET_HASH": actions, "DECISION_SET_HASH": decided,
        "CANDIDATE_HASH": candidate, "RELEASE_HASH": table, "CHANGES_HASH": entries,
    }
    try:
        with scratch(source.sparkSession), lean_shuffles(source.sparkSession):  # only the fingerprints of the second run are kept
            again = execute(plan, source)
        observed["REEXECUTION_RELEASE_HASH"] = again.prints["release"]
        observed["REEXECUTION_VALIDATIONS"] = canonical_json([[c[0], c[1]] for c in again.checks])
    except GovernanceError as error:
        observed["REEXECUTION_RELEASE_HASH"] = observed["REEXECUTION_VALIDATIONS"] = f"refused:{error.code}"
    return [(name, value == stored.get(name), value, stored.get(name)) for name, value in observed.items()]


def stored_hashes(outcome: Release) -> dict[str, str]:
    """What a manifest keeps for later verification."""
    plan = outcome.plan
    return {
        "SOURCE_HASH": plan.source_print,
        "CONTRACT_HASH": plan.analysis.contract.hash,
        "ACTION_SET_HASH": plan.action_hash,
        "DECISION_SET_HASH": plan.decision_hash,
        "CANDIDATE_HASH": outcome.prints["candidate"],
        "RELEASE_HASH": outcome.prints["release"],
        "CHANGES_HASH": outcome.prints["ledger"],
        "REEXECUTION_RELEASE_HASH": outcome.prints["release"],
        "REEXECUTION_VALIDATIONS": canonical_json([[c[0], c[1]] for c in outcome.checks]),
    }


def require_current(plan: DryRun, action_hash: str, revision: int) -> None:
    """Refuse a stale or altered change set."""
    if plan.action_hash != action_hash:
        raise GovernanceError("ACTION_SET_CHANGED", action_hash, plan.action_hash)
    if plan.changes.revision != revision:
        raise GovernanceError("STALE_DRY_RUN", plan.changes.revision, revision)


