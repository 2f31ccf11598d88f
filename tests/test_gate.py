"""Planted defects end to end: exact findings, metrics, release and reconciliation."""

import pytest
from pyspark.sql import functions as F

import samples
from sluice import session
from sluice.contract import Contract
from sluice.operators import decide, detect, metrics, release
from sluice.plans import gate
from sluice.session import CLEANUP_CONF


@pytest.fixture(scope="module")
def clinical(spark):
    source = gate.written(samples.clinical(spark), "clinical").repartition(7)
    return gate.analyse(source, samples.CLINICAL)


def counts(analysis):
    return {r["finding_id"]: r["affected_record_count"] for r in analysis.findings.collect()}


def scored(frame):
    return {r["metric"]: (r["numerator"], r["denominator"]) for r in frame.collect()}


CLINICAL_FINDINGS = {
    "DUP-EXACT": 43, "CAT-region": 61, "FMT-encounter_date": 72, "CAT-diagnosis_label": 183,
    "SEM-diagnosis_label-CONFLICT": 1, "SEM-diagnosis_label": 20, "AMB-diagnosis_label": 8,
    "MISS-diagnosis_code": 27, "PHI-free_text_note": 3,
}


def test_clinical_findings(clinical):
    assert counts(clinical) == CLINICAL_FINDINGS


def test_clinical_metrics(clinical):
    assert scored(clinical.metrics) == {
        "completeness": (5173, 5200), "validity": (5128, 5200),
        "consistency": (10372, 10400), "uniqueness": (5157, 5200),
    }
    assert metrics.overall_score(clinical.metrics, samples.CLINICAL).first()[0] == pytest.approx(99.27, abs=0.01)


def test_clinical_members(clinical):
    dup = detect.members(clinical.annotated).filter("finding_id = 'DUP-EXACT'").agg(F.min("ordinal"), F.max("ordinal")).first()
    assert tuple(dup) == (5157, 5199)
    classes = detect.claim_counts(clinical.annotated).filter("finding_id = 'PHI-free_text_note'").collect()
    assert {(r["detail"], r["records"]) for r in classes} == {("email", 1), ("intl_phone", 1), ("name_label", 1)}


def test_clinical_release(spark, clinical):
    decisions = decide.default_decisions(clinical.findings)
    plan = gate.dry_run(clinical, decisions)
    outcome = gate.execute(plan)
    assert [c for c in outcome.checks if not c[1]] == []
    assert len(outcome.checks) == 14
    assert outcome.status == "CONDITIONAL_PASS"
    assert outcome.table.count() == 5101
    assert (plan.totals["quarantined"], plan.totals["excluded"], plan.totals["changed_cells"]) == (56, 43, 316)
    assert "free_text_note" not in outcome.table.columns
    again = gate.verify(outcome, clinical.source, decisions, gate.stored_hashes(outcome))
    assert [c for c in again if not c[1]] == []


def listing(folder):
    return sorted(p.name for p in folder.iterdir())


def test_verification_leaves_no_tables_and_no_shuffles(spark, clinical, monkeypatch, tmp_path):
    """The second execution meets the claims once, and its tables and shuffle files don't stay on disk."""
    monkeypatch.setattr(session, "work_folder", lambda spark: str(tmp_path))
    decisions = gate.written(decide.default_decisions(clinical.findings), "decisions")
    outcome = gate.execute(gate.dry_run(clinical, decisions))
    before, cleaning = listing(tmp_path), []
    again = gate.execute
    monkeypatch.setattr(gate, "execute", lambda *a: cleaning.append(spark.conf.get(CLEANUP_CONF, "false")) or again(*a))
    assert [c for c in gate.verify(outcome, clinical.source, decisions, gate.stored_hashes(outcome)) if not c[1]] == []
    assert listing(tmp_path) == before
    assert cleaning == ["true"] and spark.conf.get(CLEANUP_CONF, "false") == "false"


def test_reconciliation_of_altered_records(spark, clinical):
    """Missing, altered, repeated and nameless records count as a plain join of all cells counts them."""
    plan = gate.dry_run(clinical, decide.default_decisions(clinical.findings))
    known, done = clinical.known, plan.changes
    some = plan.rows.filter("ordinal BETWEEN 100 AND 160 OR ordinal BETWEEN 330 AND 380")
    rows = gate.written(some.unionByName(some.filter("ordinal IN (110, 340)")).withColumn("record_uid", F.when(F.col("ordinal") != 120, F.col("record_uid"))), "rows")
    due = release.candidate(rows, done, known)
    stored = due.filter("ordinal <> 130").withColumn("region", F.when(F.col("ordinal").isin(110, 350), "x").otherwise(F.col("region")))
    stored = gate.written(stored.unionByName(due.filter("ordinal IN (110, 345)")), "stored")
    names, edits = known.columns, release.edited_columns(done)
    for kept in (stored, due.dropDuplicates(["record_uid"])):
        pairs = rows.join(kept.select("record_uid", F.struct(*names).alias("stored")), "record_uid", "left").collect()
        differ = [c for r in pairs for c in names if r[c] != (r["stored"] and r["stored"][c])]
        got = release.reconciliation(rows, kept, done, clinical.contract, known).first()
        assert got["changed_cells"] == len(differ)
        assert got["unapproved_cells"] >= sum(c not in edits for c in differ) > 0
        assert got["filled_after"] == sum(bool(r["stored"] and (r["stored"]["diagnosis_code"] or "").strip()) for r in pairs)


def test_clinical_tamper(clinical):
    plan = gate.dry_run(clinical, decide.default_decisions(clinical.findings))
    changed = clinical.source.withColumn("region", F.when(F.col("ordinal") == 4000, "South!").otherwise(F.col("region")))
    failed = [c[0] for c in gate.execute(plan, changed).checks if not c[1]]
    assert "SOURCE_IMMUTABLE" in failed
    grown = clinical.source.unionByName(clinical.source.limit(1).withColumn("ordinal", F.lit(9999).cast("bigint")))
    with pytest.raises(decide.GovernanceError, match="SOURCE_ARTIFACT_CHANGED"):
        gate.execute(plan, grown)


def test_clinical_veto(spark, clinical):
    veto = spark.createDataFrame([("CAT-region", "REJECT_PROPOSAL", 1)], "finding_id string, outcome string, run_revision int")
    plan = gate.dry_run(clinical, decide.default_decisions(clinical.findings).unionByName(veto))
    assert plan.totals["changed_cells"] == 316 - 61
    assert plan.changes.dispositions["CAT-region"] == "PROPOSAL_REJECTED"


def test_refusals(spark, clinical):
    decisions = decide.default_decisions(clinical.findings)
    with pytest.raises(decide.GovernanceError, match="UNRESOLVED_FINDINGS"):
        gate.dry_run(clinical, decisions.limit(1))
    with pytest.raises(decide.GovernanceError, match="DECISION_REVISION_MISMATCH"):
        gate.dry_run(clinical, decisions, revision=2)
    wrong = decisions.withColumn("outcome", F.lit("EXCLUDE"))
    with pytest.raises(decide.GovernanceError, match="OUTCOME_NOT_ALLOWED"):
        gate.dry_run(clinical, wrong)


def test_stale_change_set(clinical):
    plan = gate.dry_run(clinical, decide.default_decisions(clinical.findings))
    gate.require_current(plan, plan.action_hash, 1)
    with pytest.raises(decide.GovernanceError, match="ACTION_SET_CHANGED"):
        gate.require_current(plan, "0" * 64, 1)
    with pytest.raises(decide.GovernanceError, match="STALE_DRY_RUN"):
        gate.require_current(plan, plan.action_hash, 2)


def test_clinical_without_contract(clinical):
    seen = gate.analyse(clinical.source)
    assert counts(seen) == {"DUP-EXACT": 43, "FMT-encounter_date": 72, "PHI-free_text_note": 3}
    assert detect.initial_status(seen.findings, Contract()).first()["release_status"] == "NOT_EVALUATED"


def test_ecommerce(spark):
    analysis = gate.analyse(gate.written(samples.ecommerce(spark), "ecommerce"), samples.ECOMMERCE)
    assert counts(analysis) == {
        "DUP-EXACT": 120, "DUP-KEY": 80, "CAT-city": 300, "SEM-city": 33, "AMB-city": 12, "CAT-status": 200,
        "MISS-status": 60, "FMT-order_date": 550, "VAL-amount": 25, "PHI-remark": 18, "PHI-customer_phone": 8000,
    }
    outcome = gate.execute(gate.dry_run(analysis, decide.default_decisions(analysis.findings)))
    assert [c for c in outcome.checks if not c[1]] == []
    totals = outcome.plan.totals
    assert (totals["eligible"], totals["quarantined"], totals["excluded"], totals["changed_cells"]) == (7670, 210, 120, 1050)
    keys = analysis.totals.first()
    assert (keys["key_groups"], keys["key_surplus"], keys["exact_surplus"]) == (40, 40, 120)


def test_hr(spark):
    analysis = gate.analyse(gate.written(samples.hr(spark), "hr"), samples.HR)
    assert counts(analysis) == {
        "DUP-KEY": 60, "CAT-department": 90, "MISS-department": 12, "CAT-employment_type": 50, "SEM-employment_type": 6,
        "VAL-employment_type": 15, "FMT-hire_date": 120, "VAL-base_salary": 20, "PHI-id_card": 3000, "PHI-email": 3000,
    }
    assert ("SENSITIVE_WITHOUT_HIT", "name") in detect.warnings(samples.HR, analysis.known)
    outcome = gate.execute(gate.dry_run(analysis, decide.default_decisions(analysis.findings)))
    assert [c for c in outcome.checks if not c[1]] == []
    totals = outcome.plan.totals
    assert (totals["eligible"], totals["quarantined"], totals["changed_cells"]) == (2893, 107, 266)
