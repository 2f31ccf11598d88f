"""Stored runs: publishing by pointer, verification from the folder alone, intermediates that go."""

import os

import pytest
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.operators import decide, profile
from sluice.operators.decide import GovernanceError
from sluice.plans import gate, store
from sluice.queries import feeds
from sluice.session import scratch, together, work_folder, written
from sluice.sources import files


@pytest.fixture(scope="module")
def outcome(spark):
    source = written(feeds.orders_feed(spark, "/root/testdata/sf0.001"), "feed")
    analysis = gate.analyse(source, feeds.ORDER_CONTRACT)
    return gate.execute(gate.dry_run(analysis, decide.default_decisions(analysis.findings)))


@pytest.fixture
def staged(spark, outcome, tmp_path):
    return store.stage(outcome, decide.default_decisions(outcome.plan.analysis.findings), str(tmp_path), depth=2)


def failed(checks):
    return {name for name, passed, _, _ in checks if not passed}


def test_contract_survives_storage():
    again = Contract.from_dict(feeds.ORDER_CONTRACT.as_dict())
    assert again == feeds.ORDER_CONTRACT and again.hash == feeds.ORDER_CONTRACT.hash


def test_fresh_session_verifies_and_executes_again(spark, staged):
    checks = store.verify(spark.newSession(), staged.folder)
    assert failed(checks) == set() and {"AGAIN_RELEASE_HASH", "AGAIN_REEXECUTION_VALIDATIONS", "LEDGER_ROWS"} <= {c[0] for c in checks}


def test_artifacts_read_back(spark, staged, outcome):
    for name, df in (("ledger", outcome.ledger), ("release", outcome.table), ("source", outcome.plan.analysis.source), ("findings", outcome.plan.analysis.findings)):
        back = staged.table(spark, name)
        assert back.columns == df.columns
        assert store.row_tree(back, name, 1).exceptAll(store.row_tree(df, name, 1)).isEmpty()


def rewrite(spark, run, artifact, bucket, change):
    path = f"{run.path(artifact)}/__bucket={bucket}"
    kind = run.manifest["artifacts"][artifact]["format"]
    change(run.table(spark, artifact, bucket)).write.format(kind).save(f"{run.folder}/aside")
    files.delete(spark, path)
    files.move(spark, f"{run.folder}/aside", path)


def test_altered_cell_is_named_by_its_leaf(spark, staged):
    uid = staged.table(spark, "candidate").agg(F.max("record_uid")).first()[0]
    rewrite(spark, staged, "candidate", uid[0], lambda df: df.withColumn("total", F.when(F.col("record_uid") == uid, "1").otherwise(F.col("total"))))
    assert failed(store.verify(spark, staged.folder, reexecute=False)) == {"CANDIDATE_ROWS"}
    rows = [tuple(r)[:3] for r in store.differences(spark, staged, {"candidate": uid[0]}).collect()]
    assert rows == [("candidate", uid[:2], "altered")]
    other = "0" if uid[0] != "0" else "1"
    assert store.differences(spark, staged, {"candidate": other}).isEmpty()


def test_missing_swapped_and_added(spark, staged):
    files.delete(spark, staged.path("ledger"))
    rewrite(spark, staged, "release", "a", lambda df: df.union(df.limit(1).withColumn("record_uid", F.lit("aaaaaaaaaaaaaaaaaaaaaaaa"))))
    aside = f"{staged.folder}/aside"
    files.move(spark, staged.path("source"), aside)
    files.move(spark, staged.path("candidate"), staged.path("source"))
    files.move(spark, aside, staged.path("candidate"))
    checks = store.verify(spark, staged.folder)
    assert failed(checks) >= {"LEDGER_ROWS", "RELEASE_ROWS", "SOURCE_ROWS", "CANDIDATE_ROWS", "REEXECUTION"}
    states = {(r["artifact"], r["state"]) for r in store.differences(spark, staged).collect()}
    assert states >= {("ledger", "missing"), ("source", "altered"), ("candidate", "altered")}


def test_changed_manifest_and_trees(spark, staged):
    text = files.read_text(spark, f"{staged.folder}/manifest.json")
    files.write_text(spark, f"{staged.folder}/manifest.json", text.replace("CONDITIONAL_PASS", "PASS"))
    assert "MANIFEST_HASH" in failed(store.verify(spark, staged.folder, reexecute=False))
    with pytest.raises(GovernanceError) as error:
        store.switch(spark, staged.folder.split("/runs/")[0], staged.root)
    assert error.value.code == "MANIFEST_CHANGED"
    files.write_text(spark, f"{staged.folder}/manifest.json", text)
    forged = staged.nodes(spark).withColumn("digest", F.when(F.col("depth") == 0, F.lit("0" * 64)).otherwise(F.col("digest")))
    forged.write.parquet(f"{staged.folder}/forged")
    files.delete(spark, f"{staged.folder}/trees")
    files.move(spark, f"{staged.folder}/forged", f"{staged.folder}/trees")
    assert failed(store.verify(spark, staged.folder, reexecute=False)) == {"TREE_ROOTS"}


def test_pointer_moves_only_to_releases(spark, outcome, staged, monkeypatch):
    base = staged.folder.split("/runs/")[0]
    assert store.current(spark, base) is None
    store.switch(spark, base, staged.root)
    assert store.current(spark, base).root == staged.root
    blocked = gate.execute(outcome.plan, outcome.plan.analysis.source.withColumn("phase", F.upper("phase")))
    assert blocked.status == "BLOCKED"
    run = store.stage(blocked, decide.default_decisions(outcome.plan.analysis.findings), base)
    with pytest.raises(GovernanceError) as error:
        store.switch(spark, base, run.root)
    assert error.value.code == "RELEASE_BLOCKED" and store.current(spark, base).root == staged.root
    with pytest.raises(GovernanceError, match="RUN_NOT_STAGED"):
        store.switch(spark, base, "0" * 64)
    # A failure between staging and the switch leaves the last release.
    monkeypatch.setattr(store, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.release_run(outcome.plan.analysis.source.where("ordinal > 100"), feeds.ORDER_CONTRACT, base)
    assert store.current(spark, base).root == staged.root
    assert store.current(spark, base).table(spark, "release").count() == outcome.table.count()


def test_run_leaves_outputs_and_manifest_only(spark, outcome, tmp_path):
    before = set(os.listdir(work_folder(spark)))
    run = store.release_run(outcome.plan.analysis.source, feeds.ORDER_CONTRACT, str(tmp_path))
    assert set(os.listdir(work_folder(spark))) == before
    assert {name for name in os.listdir(tmp_path) if not name.startswith(".")} == {"runs", "CURRENT"}
    assert {n for n in os.listdir(run.folder) if not n.startswith(".")} == {"artifacts", "trees", "manifest.json"}
    again = store.stage(outcome, decide.default_decisions(outcome.plan.analysis.findings), str(tmp_path))
    assert again.manifest["hashes"] == run.manifest["hashes"]


def test_scratch_covers_threads_and_errors(spark):
    with pytest.raises(ValueError):
        with scratch(spark) as folder:
            made = together(lambda: written(spark.range(3).toDF("n"), "a"), lambda: written(spark.range(2).toDF("n"), "b"))
            assert [df.count() for df in made] == [3, 2] and len(os.listdir(folder)) == 2
            raise ValueError
    assert not os.path.exists(folder)


def test_candidate_profile_without_profiling_again(spark, outcome):
    counts, _ = gate.profiled(outcome.plan.analysis.source)
    fresh, facts = gate.profiled(outcome.candidate)
    moved = gate.edited_counts(outcome, counts)
    assert moved.exceptAll(fresh.select(*moved.columns)).isEmpty() and fresh.select(*moved.columns).exceptAll(moved).isEmpty()
    expected = profile.column_profile(outcome.candidate, fresh, facts, feeds.ORDER_CONTRACT)
    text = [F.to_json(F.struct("*")).alias("row")]
    assert {r["row"] for r in gate.candidate_profile(outcome, counts).select(*text).collect()} == {r["row"] for r in expected.select(*text).collect()}
    kept = outcome.plan.rows.filter("membership IS NULL").select("record_uid").join(outcome.candidate, "record_uid")
    released = gate.profiled(kept.select(*outcome.candidate.columns))[0]
    after = gate.edited_counts(outcome, counts, released=True)
    assert after.exceptAll(released.select(*after.columns)).isEmpty() and after.count() == released.count()


def test_masked_edits_move_counts_too(spark):
    rows = [(i, f"u{i}", "2024/01/0" + str(1 + i % 5)) for i in range(20)]
    source = spark.createDataFrame(rows, "ordinal long, record_uid string, day string")
    contract = Contract.from_dict({
        "id": "d", "version": "1", "fields": {"day": {"type": "date", "format": "%Y-%m-%d", "accept_formats": ["%Y/%m/%d"], "sensitive": True}},
        "auto_authorization": {"date_standardization": True},
    })
    analysis = gate.analyse(source, contract)
    made = gate.execute(gate.dry_run(analysis, decide.default_decisions(analysis.findings)))
    moved = gate.edited_counts(made, gate.profiled(source)[0])
    fresh = gate.profiled(made.candidate)[0]
    assert moved.exceptAll(fresh.select(*moved.columns)).isEmpty() and moved.count() == fresh.count() == 5


def test_foreign_records_are_refused(spark, outcome):
    source = outcome.plan.analysis.source
    other = source.withColumn("record_uid", F.when(F.col("ordinal") == 4, "f" * 24).otherwise(F.col("record_uid")))
    with pytest.raises(GovernanceError) as error:
        gate.execute(outcome.plan, other)
    assert error.value.code == "FOREIGN_RECORDS"


def test_facts_name_every_score(spark, outcome):
    facts = {r["fact_id"]: r["value"] for r in gate.release_facts(outcome.plan.analysis, outcome, 2).collect()}
    assert len(facts) == 28 and facts["validations_passed"] == facts["validations_total"] == "14" and facts["ai_call_count"] == "2"
    assert {f"candidate_metric_{m}" for m in ("completeness", "validity", "consistency", "uniqueness")} <= set(facts)
    assert float(facts["candidate_overall_score"]) >= float(facts["overall_score"])
    before = {r["fact_id"]: r["value"] for r in gate.release_facts(outcome.plan.analysis).collect()}
    assert before["release_status"] == "BLOCKED" and "validations_passed" not in before and len(before) == 15
