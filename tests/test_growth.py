"""Shortcuts that keep large tables cheap give what the plain rules give."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.functions import dates, hashing, patterns, text
from sluice.operators import decide, groups, profile
from sluice.plans import gate, store

CELLS = [
    None, "", " ", "\t", "　", " x", "~", "!", "é", "a", "\x7f", "\x1f", "a@b.cc", "x @ y", "name: B", "姓名：李", "Patient:x", "note: x", "+65 9123 4567", "+6591234567", "+x",
    "123-456-7890", "(123) 456 7890", "123)456", "12345678901", "13812345678", "x13812345678y", "110101199003071234", "11010119900307123X", "4111111111111111",
    "1995-02-28", "1995-02-29", "1996-02-29", "0000-01-01", "1995-2-3", "03/04/1995", "31/04/1995", "1995/01/02", "1995/13/01", "19950102", "+12345-01-02", "1995-01-02\n",
    "1995-01-02T08:00:00Z", "TRUE", "yEs", "n", "YES ", "是", "否", "ſ", "no\n",
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, v string")


def plain_class(value):
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, regex in patterns.SENSITIVE_RX.items():
        chain = chain.when(value.rlike("(?U)" + regex), name)
    return chain


def test_shortcuts_of_cells(cells):
    value = F.col("v")
    formats = ["%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%Y%m%d"]
    pairs = {
        "blank": (text.is_blank(value), F.coalesce(~value.rlike(r"(?U)\S"), F.lit(True))),
        "sensitive": (patterns.sensitive_class(value), plain_class(value)),
        "boolean": (patterns.is_boolean(value), F.lower(value).isin(*patterns.BOOLEAN_TOKENS)),
        **{f: (dates.parses(value, f, datetime=False), F.try_to_date(value, dates.spark_format(f, parsing=True)).isNotNull()) for f in formats},
        "time": (dates.parse_datetime(value, "%Y-%m-%d %H:%M:%S"), F.try_to_timestamp(value, F.lit("yyyy-M-d H:m:s"))),
    }
    wrong = cells.select("v", *[(~new.eqNullSafe(old)).alias(name) for name, (new, old) in pairs.items()])
    assert [(r["v"], n) for r in wrong.collect() for n in pairs if r[n]] == []


def test_encoded_cells(spark):
    row = spark.createDataFrame([("a|b", None, "", "日本")], "a string, b string, c string, d string")
    assert row.select(hashing.encoded(["a", "b", "c", "d"])).first()[0] == "3:a|b|-|0:|2:日本"


def test_digest_is_sixteen_bytes(spark):
    row = spark.createDataFrame([("x",)], "a string")
    assert row.select(groups.digest(["a"]).alias("d")).first()["d"] == bytes.fromhex(row.select(hashing.row_digest(["a"])).first()[0])[:16]


def test_join_back_shuffles_grouped_rows_only(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id < 1000 THEN 'hot' WHEN id % 2 = 0 THEN NULL ELSE 'k' || (id div 4) END AS k")
    sized = groups.repeated(rows, "k").filter("k = 'hot' OR k LIKE '%7'")
    expected = {(r["id"], r["k"], r["group_size"]) for r in rows.join(sized, "k").collect()}
    monkeypatch.setattr(groups, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(groups, "SALTED_GROUP", 100)
    for size in ("group_size", None):
        found = groups.join_back(rows, sized, "k", "id", size=size)
        assert {(r["id"], r["k"], r["group_size"]) for r in found.collect()} == expected
        assert found.count() == len(expected)
    assert groups.maybe_grouped(rows, sized, ["k"]).count() < len(expected) + 100
    left = groups.join_back(rows, sized, "k", "id", "left", size="group_size")
    assert left.count() == 4000 and left.filter("group_size IS NOT NULL").count() == len(expected)


def test_rules_are_matched_once(spark):
    rows = spark.createDataFrame([(i, f"u{i}", str(i % 3) if i else None) for i in range(9)], "ordinal bigint, record_uid string, a string")
    contract = Contract.from_dict({"id": "c", "version": "1", "business_key": [], "fields": {"a": {"required": True}}})
    analysis = gate.settled(gate.analyse(rows, contract))
    assert gate.settled(analysis) is analysis
    assert any("/annotated-" in f for f in analysis.annotated.inputFiles()) and any("/findings-" in f for f in analysis.findings.inputFiles())
    assert {r["finding_id"]: r["affected_record_count"] for r in analysis.findings.collect()}["MISS-a"] == 1


def test_stored_ledger_is_packed(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{i:02x}" * 12, str(i % 3) if i else None) for i in range(9)], "ordinal bigint, record_uid string, a string")
    contract = Contract.from_dict({"id": "c", "version": "1", "business_key": [], "fields": {"a": {"required": True}}})
    analysis = gate.settled(gate.analyse(rows, contract))
    decisions = decide.default_decisions(analysis.findings)
    run = store.stage(gate.execute(gate.dry_run(analysis, decisions)), decisions, str(tmp_path))
    assert list(tmp_path.glob("runs/*/artifacts/ledger/*/*.json.gz")) and not list(tmp_path.glob("runs/*/artifacts/ledger/*/*.json"))
    assert run.table(spark, "ledger").filter("finding_id = 'MISS-a'").count() == 1 and store.differences(spark, run).count() == 0


def test_counts_group_by_three_keys(spark):
    note, blank = "name: " + "word " * 40, " " * 200
    texts = [note, note, note + "x", blank, "a" * 128, "1" * 129, "7", "7", " ", None, None]
    counts = profile.cell_counts(spark.createDataFrame([(t, "c") for t in texts], "v string, w string"), ["v", "w"])
    aggregate = re.search(r"Aggregate \[([^]]*)\]", counts._jdf.queryExecution().optimizedPlan().toString())
    assert aggregate[1].count(",") == 2  # not eight: they are the rows of the hash table
    found = {(r["column"], r["value"]): tuple(r)[2:] for r in counts.collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {
        ("v", digest(note)): (True, note[:128], 2, False, "mixed", "name_label", len(note)),
        ("v", digest(note + "x")): (True, note[:128], 1, False, "mixed", "name_label", len(note) + 1),
        ("v", digest(blank)): (True, blank[:128], 1, True, "text", None, 200),
        ("v", "a" * 128): (False, "a" * 128, 1, False, "text", None, 128),
        ("v", "1" * 129): (False, "1" * 129, 1, False, "digits", None, 129),
        ("v", "7"): (False, "7", 2, False, "digits", None, 1),
        ("v", " "): (False, " ", 1, True, "text", None, 1),
        ("v", None): (False, None, 2, True, "mixed", None, None),
        ("w", "c"): (False, "c", len(texts), False, "text", None, 1),
    }
