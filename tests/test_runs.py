"""Proposals, claims, drafts, streams and run tables against small worked cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.operators import ground, profile, runs
from sluice.plans import gate
from sluice.streaming import admission, logs

REQUEST = "request_id string, finding_id string, column string, input_hash string"
PROPOSAL = (
    "proposal_id string, request_id string, finding_id string, column string, input_hash string, action string, "
    "abstained boolean, mapping map<string,string>, evidence_refs array<string>"
)
GOOD = {"finding_id": "SEM-c", "column": "c", "input_hash": "h", "action": "NORMALIZE_CATEGORY", "abstained": False, "mapping": {"foo": "FOO"}, "evidence_refs": ["E1"]}
FAULTS = {
    "UNKNOWN_FINDING": {"finding_id": "SEM-x"}, "UNKNOWN_COLUMN": {"column": "x"}, "STALE_OR_UNKNOWN_INPUT": {"input_hash": "old"},
    "HALLUCINATED_SOURCE_VALUE": {"mapping": {"never": "FOO"}}, "UNKNOWN_CANONICAL_TARGET": {"mapping": {"foo": "BAR"}},
    "UNKNOWN_EVIDENCE_REFERENCE": {"evidence_refs": ["E1", "E9"]}, "AMBIGUITY_REGISTRY_HIT": {"mapping": {"amb": "FOO"}},
    "UNSUPPORTED_ACTION": {"action": "DELETE_ROWS"}, "ABSTENTION_WITH_MAPPING": {"abstained": True},
}


def test_mapping_reasons(spark):
    rows = [{"proposal_id": "GOOD", "request_id": "r", **GOOD}]
    rows += [{"proposal_id": code, "request_id": "r", **GOOD, **change} for code, change in FAULTS.items()]
    proposals = spark.createDataFrame(rows, PROPOSAL)
    checked = ground.ground_mappings(
        proposals,
        spark.createDataFrame([("r", "SEM-c", "c", "h")], REQUEST),
        spark.createDataFrame([("r", "foo", 5), ("r", "amb", 2)], "request_id string, value string, cnt bigint"),
        spark.createDataFrame([("r", "FOO")], "request_id string, value string"),
        spark.createDataFrame([("r", "amb")], "request_id string, value string"),
        spark.createDataFrame([("r", "E1")], "request_id string, value string"),
    )
    got = {r["proposal_id"]: (r["valid"], r["reasons"], r["affected_records"]) for r in checked.collect()}
    assert got.pop("GOOD") == (True, [], 5)
    assert got == {code: (False, [code], 0) for code in FAULTS}


def test_number_tokens(spark):
    cases = {
        "1,234 of 5.": ["1,234", "5"], "１２．５％ done": ["12.5"], "v1.2.3 and 7": ["7"], "no number": [], "3,": ["3"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ground.number_tokens(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == cases


def test_claims(spark):
    facts = [("record_count", 5200), ("score", 99.27), ("contract", "clinical 1.2")]
    claims = spark.createDataFrame(
        [(1, "5,200 records at 99.27", ["record_count"]), (2, "about 5201 records", ["record_count"]), (3, "fine", ["made_up"]), (4, "version 1.2", ["contract"])],
        "claim_id int, text string, fact_ids array<string>",
    )
    got = {r["claim_id"]: r["reason"] for r in ground.verify_claims(claims, facts).collect()}
    assert got == {1: None, 2: "UNVERIFIED_NUMBER:5201", 3: "UNKNOWN_FACT:made_up", 4: None}


def test_draft(spark):
    df = spark.range(40).select(
        F.format_string("A%02d", "id").alias("order_id"), F.when(F.col("id") % 4 == 0, "red").when(F.col("id") == 1, "RED").otherwise("blue").alias("colour"),
        F.format_string("2026-01-%02d", F.col("id") % 28 + 1).alias("day"), F.lit(None).cast("string").alias("nothing"), F.format_string("u%d@example.com", "id").alias("contact"),
    )
    counts, facts = gate.profiled(df)
    shown = gate.written(profile.column_profile(df, counts, facts, Contract()), "profile")
    fields = {r["column"]: r for r in ground.draft_fields(shown, ground.observed_formats(facts)).collect()}
    assert fields["order_id"]["unique"] and fields["order_id"]["required"] and not fields["nothing"]["required"]
    assert (fields["day"]["type"], fields["day"]["format"]) == ("date", "%Y-%m-%d")
    assert fields["colour"]["allowed"] == ["blue", "red", "RED"] and fields["contact"]["sensitive"] and fields["contact"]["allowed"] == []
    assert [tuple(r) for r in ground.draft_canonical(shown).collect()] == [("colour", "red", "RED")]
    assert ground.draft_business_key(ground.draft_fields(shown, ground.observed_formats(facts)), df.columns).first()[0] == "order_id"
    assert {r["column"] for r in ground.observed_values(shown).collect()} == {"order_id", "colour", "day"}


def test_admission_matches_brute_force(spark, sf_dir):
    from sluice.queries.run_queries import sliding_admission

    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in sliding_admission(spark, sf_dir).collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    admitted: dict[int, list[float]] = {}
    for row in sorted(events.collect(), key=lambda r: (r["user_id"], r["at"], r["event_id"])):
        inside = [t for t in admitted.get(row["user_id"], []) if t > row["at"] - 3600]
        allowed = len(inside) < 3
        if allowed:
            admitted.setdefault(row["user_id"], []).append(row["at"])
        assert got[row["event_id"]][0] == allowed
        assert (got[row["event_id"]][1] == 0) == allowed
    assert len(got) == events.count()


def test_admission_waits(spark):
    times = [(0, 0.0), (1, 1.0), (2, 2.5), (3, 10.0), (4, 10.5), (5, 40.0)]
    events = spark.createDataFrame([(i, "k", t) for i, t in reversed(times)], "event_id bigint, key string, at double")
    got = sorted((r["event_id"], r["allowed"], r["retry_after"]) for r in admission.admission(events, 2, 10.0).collect())
    assert got == [(0, True, 0), (1, True, 0), (2, False, 8), (3, True, 0), (4, False, 1), (5, True, 0)]
    assert [r["retry_after"] for r in admission.admission(events.limit(1), 0, 10.0).collect()] == [10]


def test_admission_holds_no_session(spark):
    """A key without any pause is one session: its events are never gathered into one row."""
    events = spark.range(30_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("key"), F.col("id").cast("double").alias("at"))
    decided = admission.admission(events, 2, 10.0)
    plan = decided._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in decided.collect()}
    assert got == {i: (i % 10 < 2, 0 if i % 10 < 2 else 10 - i % 10) for i in range(30_000)}


def test_streamed_budget_and_apply_once(spark, tmp_path):
    rows = [("k1", "2026-01-01 01:00:00"), ("k1", "2026-01-01 02:00:00"), ("k2", "2026-01-01 03:00:00"), ("k3", "2026-01-02 03:00:00"), ("k4", "2026-01-04 03:00:00")]
    spark.createDataFrame(rows, "key string, ts string").selectExpr("key", "CAST(ts AS TIMESTAMP) AS ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    budget = run(logs.daily_calls(stream, "ts", 2), "budget", "complete")
    assert {(str(r["day"]), r["calls_used"], r["refused"]) for r in budget.collect()} == {("2026-01-01", 2, 1), ("2026-01-02", 1, 0), ("2026-01-04", 1, 0)}
    once = run(logs.apply_once(stream, "key", "ts"), "once", "append")
    assert sorted(r["key"] for r in once.collect()) == ["k1", "k2", "k3", "k4"]


def test_conservation_of_hashes(spark):
    df = spark.createDataFrame([("r1", "a", "x"), ("r1", "a", "y"), ("r2", "b", "z")], "run_id string, source_hash string, release_hash string")
    got = {r["run_id"]: (r["source_hash"], r["release_hash"]) for r in runs.chain_audit(df, ["run_id"], ["source_hash", "release_hash"]).collect()}
    assert got == {"r1": (True, False), "r2": (True, True)}


def test_owners(spark):
    members = spark.createDataFrame([("QUARANTINED", "u", 2), ("QUARANTINED", "u", 1), ("FLAGGED", "u", 0)], "status string, record_uid string, action_rank int")
    assert {(r["status"], r["action_rank"]) for r in runs.first_owner(members).collect()} == {("QUARANTINED", 1), ("FLAGGED", 0)}
    cells = spark.createDataFrame([("c", "u", 1), ("c", "u", 4)], "column string, record_uid string, action_rank int")
    assert runs.last_owner(cells).first()["action_rank"] == 4


@pytest.mark.parametrize("name", [
    "column_facts_orders", "column_profile_documents", "top_values_part", "sensitive_scan_documents", "exact_duplicates", "key_conflict_members",
    "scope_fingerprint", "gate_findings", "gate_members", "gate_metrics", "violation_examples", "change_ledger", "release_table", "cell_diff",
    "release_validations", "run_dispositions", "event_sequence", "mapping_grounding", "rule_grounding", "claim_verification", "contract_draft_part",
])
def test_against_sql(spark, sf_dir, name):
    from oracle_check import compare, connect

    import __spark_entry__ as entry

    assert compare(spark, connect(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_registry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {n for n in names - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"} == set()


def test_streamed_admission_equals_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"k{rng.choice([0, 0, 0, 1, 2])}", 1_700_000_000 + int(60 * i + rng.uniform(-500, 500))) for i in range(400)]
    for n, first in enumerate(range(0, 400, 80)):
        chunk = spark.createDataFrame(rows[first : first + 80], "event_id bigint, key string, sec bigint").selectExpr("event_id", "key", "timestamp_seconds(sec) AS ts")
        chunk.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    far = "SELECT {} AS event_id, 'k{}' AS key, timestamp_seconds({}) AS ts"
    spark.sql(far.format(-1, 9, 1_800_000_000)).write.parquet(str(tmp_path / "in/8"))
    spark.sql(far.format(-2, 9, 1_800_100_000) + " UNION ALL " + far.format(-3, 0, 1_700_000_000)).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema("event_id bigint, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    decided = admission.admission_stream(stream, 3, 600.0, "30 minutes")
    query = decided.writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in spark.table("admitted").collect() if r["event_id"] >= 0}
    table = spark.createDataFrame(rows, "event_id bigint, key string, at bigint")
    expected = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in admission.admission(table, 3, 600.0).collect()}
    assert got == expected and 0 < sum(a for a, _ in got.values()) < 400
    assert admission.late_events([json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]) == 1


def test_ring_without_times_and_limits(spark):
    events = spark.createDataFrame([(0, None, 1.0), (1, None, 2.0), (2, "k", None), (3, "k", 5.0), (4, "k", 5.0)], "event_id bigint, key string, at double")
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in admission.admission(events, 1, 10.0).collect()}
    assert got == {0: (True, 0), 1: (False, 9), 2: (True, 0), 3: (True, 0), 4: (False, 10)}
    assert {r["event_id"]: (r["allowed"], r["retry_after"]) for r in admission.admission(events, 0, 10.0).collect()}[2] == (False, 1)


def test_repeated_call_ids_keep_one_row_per_proposal(spark):
    proposals = spark.createDataFrame([("p1", "c1", "F", "h"), ("p2", "c2", "F", "h"), ("p3", "c9", "F", "h")], "proposal_id string, call_id string, finding_id string, input_hash string")
    calls = spark.createDataFrame([("c1", "F", "h"), ("c1", "G", "h"), ("c1", "F", "h"), ("c2", "G", "x")], "call_id string, finding_id string, input_hash string")
    got = sorted(tuple(r) for r in runs.proposals_against_calls(proposals, calls).collect())
    assert got == [("p1", True, True, True), ("p2", True, False, False), ("p3", False, False, False)]


def test_alias_grounding_keeps_the_first_owner(spark):
    shown = spark.createDataFrame([("c", v) for v in "abcdef"], "column string, value string")
    drafted = [
        ("c", 0, "a", ["b", "b", "a"]), ("c", 1, "b", ["c"]), ("c", 2, "d", ["b", "c"]), ("c", 3, "e", ["a", "d"]), ("c", 4, "f", ["zz"]), ("c", 5, "f", []), ("none", 0, "a", ["b"]),
    ]
    entries = spark.createDataFrame(drafted, "field string, position int, target string, aliases array<string>").repartition(3)
    got = {(r["field"], r["position"]): (r["aliases"], r["status"]) for r in ground.ground_aliases(entries, shown).collect()}
    assert got == {
        ("c", 0): (["b"], "ACCEPTED"), ("c", 1): ([], "SKIPPED"), ("c", 2): (["c"], "ACCEPTED"), ("c", 3): ([], "SKIPPED"), ("c", 4): ([], "REJECTED"),
        ("c", 5): ([], "SKIPPED"), ("none", 0): ([], "REJECTED"),
    }
