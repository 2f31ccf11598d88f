"""Contract sanity, value patterns, dates, generic table, invariance and leaks."""

import pytest
from pyspark.sql import functions as F

import samples
from sluice.contract import Contract, ContractError
from sluice.functions import dates, hashing, patterns, predicates, text
from sluice.operators import detect, groups, profile, release, sketches
from sluice.plans import gate
from sluice.sources.tables import with_identity

FIELD = {"a": {"type": "number"}}


@pytest.mark.parametrize(
    ("fields", "code"),
    [
        ({"a": {"canonical": {"X": ["x"], "Y": ["x"]}}}, "CONTRACT_ALIAS_CONFLICT"),
        ({"a": {"canonical": {"X": ["Y"], "Y": ["y"]}}}, "CONTRACT_ALIAS_CONFLICT"),
        ({"a": {"format": "%Y"}}, "CONTRACT_FORMAT_INVALID"),
        ({"a": {"type": "date", "format": "YYYY"}}, "CONTRACT_FORMAT_INVALID"),
        ({"a": {"min": 3, "max": 2}}, "CONTRACT_RANGE_INVALID"),
        ({"a": {"pattern": "("}}, "CONTRACT_PATTERN_INVALID"),
        ({"a": {"canonical": {"X": ["x"]}, "consistent_with": {"column": "a", "expected": {}}}}, "CONTRACT_CONSISTENCY_INVALID"),
        ({"a": {"consistent_with": {"column": "b", "expected": {}}}}, "CONTRACT_CONSISTENCY_INVALID"),
        ({" ": {}}, "CONTRACT_FIELD_NAME_INVALID"),
        ({"a": {"type": "money"}}, "CONTRACT_SCHEMA_INVALID"),
        ({"a": {"colour": 1}}, "CONTRACT_SCHEMA_INVALID"),
        ({"a": {"allowed": [str(i) for i in range(201)]}}, "CONTRACT_TOO_MANY_ALLOWED"),
        ({f"f{i}": {} for i in range(201)}, "CONTRACT_TOO_MANY_FIELDS"),
    ],
)
def test_contract_refusals(fields, code):
    with pytest.raises(ContractError) as error:
        Contract.from_dict({"id": "c", "version": "1", "fields": fields})
    assert error.value.code == code


def test_contract_hash_covers_defaults():
    base = Contract.from_dict({"id": "c", "version": "1", "fields": FIELD})
    same = Contract.from_dict({"id": "c", "version": "1", "fields": {"a": {"type": "number", "required": False}}})
    other = Contract.from_dict({"id": "c", "version": "1", "fields": {"a": {"type": "number", "required": True}}})
    assert base.hash == same.hash != other.hash
    with pytest.raises(ContractError, match="CONTRACT_WEIGHTS_INVALID"):
        Contract.from_dict({"id": "c", "version": "1", "score": {"weights": dict.fromkeys(("completeness", "validity", "consistency", "uniqueness"), 0)}})


def values(spark, items, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [tuple(r) for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").select(*columns).collect()]


def test_sensitive_classes(spark):
    cases = [
        ("jane@example.org", "email"), ("id 11010119900101123X.", "cn_id"), ("13812345678", "cn_mobile"), ("6222021234567890123", "bank_card"),
        ("+65 9123 4567", "intl_phone"), ("(555) 123-4567", "intl_phone"), ("Patient: Roe", "name_label"), ("姓名：张", "name_label"),
        ("11010119900101123", "bank_card"), ("NAME : x", "name_label"),
        ("", None), (None, None), ("hello world", None), ("2026-01-02T03:04:05Z", None), ("12345", None), ("a@b", None), ("12812345678", None),
        ("REC-00001", None), ("+1", None), ("123-45-6789", None),
    ]
    got = values(spark, [c[0] for c in cases], k=patterns.sensitive_class(F.col("v")), m=patterns.mask_value(F.col("v")))
    assert [g[0] for g in got] == [c[1] for c in cases]
    assert all(not c[0] or g[1] in {*patterns.MASKS.values(), patterns.GENERIC_MASK} for c, g in zip(cases, got))


def test_guard_never_hides_a_class(spark):
    """The cheap first scan must let through whatever one of the six patterns would match."""
    pieces = ["a@b.cc", "1" * 17 + "x", "19912345678", "4" * 16, "+1(2)3.4-5 6789", "+123456789", "555.123.4567", "name:x", "姓名:x", "Name　：　x"]
    items = [pad + p + pad for p in pieces for pad in ("", " ", "é", "\n")]
    plain = F.coalesce(*[F.when(F.col("v").rlike("(?U)" + rx), n) for n, rx in patterns.SENSITIVE_RX.items()])
    for guarded, bare in values(spark, items, g=patterns.sensitive_class(F.col("v")), b=plain):
        assert guarded == bare is not None


def test_shapes(spark):
    cases = {
        "2026-01-02T03:04": patterns.ISO_DATETIME, "2026-01-02": patterns.YMD_DASH, "2026-13-02": patterns.MIXED, "2026/01/02": patterns.YMD_SLASH,
        "13/01/2026": patterns.SLASH_UNDECIDED, "20260102": patterns.YMD_COMPACT, "+12": patterns.DIGITS, "１２": patterns.DIGITS, "1.5e3": patterns.DECIMAL,
        ".5": patterns.DECIMAL, "Yes": patterns.BOOLEAN, "是": patterns.BOOLEAN, "Été chaud": patterns.TEXT, "a-b": patterns.MIXED, "12\n": patterns.MIXED,
    }
    assert [r[0] for r in values(spark, list(cases), s=patterns.shape_label(F.col("v")))] == list(cases.values())


def test_text_and_dates(spark):
    blank = values(spark, [None, "", " \t　", "x "], b=text.is_blank(F.col("v")), s=text.strip_text(F.col("v")))
    assert [b for b, _ in blank] == [True, True, True, False] and blank[3][1] == "x"
    assert text.fold_text("  ＡＢＣ　Straße ") == "abc strasse"
    assert values(spark, ["  ＡＢＣ　x "], n=text.normalize_text(F.col("v")))[0][0] == "abc x"
    stamp = dates.reformat(F.col("v"), "%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M")
    day = dates.reformat(F.col("v"), "%d/%m/%Y", "%Y-%m-%d")
    assert values(spark, ["12/1/2010 8:26", "31/02/2026"], a=stamp, b=day) == [("2010-12-01 08:26", "12/1/2010 8:26"), ("31/02/2026", "31/02/2026")]
    assert dates.label_to_format("DD/MM/YYYY HH:MM:SS") == "%d/%m/%Y %H:%M:%S" and dates.label_to_format("digits") is None


def test_range_and_pattern(spark):
    rule = Contract.from_dict({"id": "c", "version": "1", "fields": {"a": {"type": "number", "min": 0, "max": 10, "pattern": "[0-9]+", "max_length": 2}}}).fields["a"]
    bad = predicates.violations(F.col("v"), rule)
    got = values(spark, ["5", "12d", "-1", "11", "1.5", "5\n", "007"], **bad)
    assert got == [
        (False, False, False), (True, True, True), (True, False, True), (True, False, False), (False, True, True), (True, False, True), (False, True, False),
    ]
    named = predicates.regex_violated(F.col("v"), r"(?P<n>[0-9]+)")
    assert values(spark, ["12", "x"], n=named) == [(False,), (True,)]


def test_patterns_the_engine_refuses(spark):
    asked = {r"[0-9]+": True, r"(?P<n>\d)": False, r"(?a:\w+)": False, r"(a)?(?(1)b|c)": False, r"x\Z": False, r"(?i)ab|c{2}": True}
    assert {p: predicates.runs_in_jvm(p) for p in asked} == asked
    bad = predicates.regex_violated(F.col("v"), r"(?a:\w+)")
    assert values(spark, ["ab", "é", None, "ab", "a b", ""], b=bad) == [(False,), (True,), (True,), (False,), (True,), (True,)]


def test_sketches_of_runs_merge(spark):
    df = spark.range(6000).selectExpr("CAST(id % 3 AS STRING) AS run", "CAST(id % 2000 AS STRING) AS a", "IF(id % 2 = 0, ' ', 'x') AS b", "CAST(NULL AS STRING) AS c")
    parts = sketches.summaries(df, ["a", "b", "c"], "run")
    assert parts.count() == 9
    whole = {r["column"]: r for r in sketches.compared(df, ["a", "b", "c"], sketches.merged(parts)).collect()}
    assert {c: (r["cells"], r["filled"], r["exact"], r["within"]) for c, r in whole.items()} == {
        "a": (6000, 6000, 2000, True), "b": (6000, 3000, 1, True), "c": (6000, 0, 0, True),
    }
    again = sketches.estimates(sketches.merged(parts.unionByName(parts))).collect()
    assert {r["column"]: r["estimate"] for r in again} == {c: r["estimate"] for c, r in whole.items()}  # merging twice counts no value twice


def generic(spark):
    """63 x 12: one column per inferred type, rows 5-7 repeated."""
    i = F.col("id")
    rows = spark.range(60).select(
        "id",
        F.format_string("ORD-%03d", i).alias("order_id"),
        F.when(i < 32, "acme").otherwise("Acme").alias("客户"),
        F.when(i.between(33, 35), "-5.00").otherwise(F.format_string("%d.50", i + 1)).alias("amount"),
        F.col("id").cast("string").alias("qty"),
        F.when(i % 2 == 0, "yes").otherwise("no").alias("active"),
        F.when(i.between(40, 44), F.format_string("%02d/03/2026", i - 20)).otherwise(F.format_string("2026-03-%02d", i % 28 + 1)).alias("order_date"),
        F.format_string("2026-03-%02dT10:00:00Z", i % 28 + 1).alias("updated_at"),
        F.when(i.isin(50, 51), "").when(i == 52, "lost").otherwise("open").alias("status"),
        F.format_string("0.%d", i + 1).alias("score"),
        F.format_string("t%d;u", i % 3).alias("tags"),
        F.when(i == 10, "a@example.com").when(i == 11, "13812345678").when(i == 12, "姓名: 李").otherwise("无").alias("备注"),
        F.lit(None).cast("string").alias("empty_col"),
    )
    copies = rows.filter(i.between(5, 7)).withColumn("id", i + 55)
    return with_identity(rows.unionByName(copies), "generic", "id").drop("id")


def test_generic_table(spark):
    source = gate.written(generic(spark), "generic")
    types = {r["column"]: r["inferred_type"] for r in gate.profiled(source)[1].collect()}
    assert types == {
        "order_id": "string", "客户": "string", "amount": "number", "qty": "integer", "active": "boolean", "order_date": "date",
        "updated_at": "datetime", "status": "string", "score": "number", "tags": "string", "备注": "string", "empty_col": "empty",
    }
    seen = gate.analyse(source)
    found = {r["finding_id"]: r["affected_record_count"] for r in seen.findings.collect()}
    assert found == {"DUP-EXACT": 3, "FMT-order_date": 5, "PHI-备注": 3}
    contract = Contract.from_dict(
        {
            "id": "g", "version": "1", "business_key": ["order_id"],
            "fields": {
                "order_id": {"required": True}, "客户": {"canonical": {"Acme": ["acme"]}, "allowed": ["Acme"]}, "amount": {"type": "number", "min": 0},
                "order_date": {"type": "date", "format": "%Y-%m-%d", "accept_formats": ["%d/%m/%Y"]}, "status": {"required": True, "allowed": ["open"]},
                "备注": {"sensitive": True}, "missing_field": {"required": True},
            },
        }
    )
    ruled = gate.analyse(source, contract)
    found = {r["finding_id"]: (r["affected_record_count"], r["authorization_mode"]) for r in ruled.findings.collect()}
    assert {k: v[0] for k, v in found.items()} == {
        "DUP-EXACT": 3, "CAT-客户": 35, "FMT-order_date": 5, "MISS-status": 2, "VAL-amount": 3, "VAL-status": 1, "PHI-备注": 3,
    }
    assert found["CAT-客户"][1] == "HUMAN_APPROVAL_REQUIRED"
    assert ("FIELD_MISSING", "missing_field") in detect.warnings(contract, ruled.known)


def test_partitioning_changes_nothing(spark):
    source = gate.written(samples.hr(spark), "hr")
    results = []
    for parts in (1, 7, 64):
        df = source.repartition(parts)
        analysis = gate.analyse(df, samples.HR)
        found = sorted((r["finding_id"], r["affected_record_count"]) for r in analysis.findings.collect())
        results.append((found, release.scope_fingerprint(df).first(), release.table_fingerprint(df, analysis.columns).first()))
    assert results[0] == results[1] == results[2]
    changed = source.withColumn("department", F.when(F.col("ordinal") == 7, "x").otherwise(F.col("department")))
    assert release.table_fingerprint(changed, source.columns[2:]).first() != results[0][2]


def test_nothing_sensitive_leaks(spark):
    source = gate.written(samples.hr(spark), "hr")
    counts, facts = gate.profiled(source)
    shown = profile.column_profile(source, counts, facts, samples.HR).toJSON().collect()
    analysis = gate.analyse(source, samples.HR)
    told = analysis.findings.toJSON().collect() + detect.claim_counts(analysis.annotated).toJSON().collect()
    rows = detect.masked_rows(source, detect.samples(detect.members(analysis.annotated)), samples.HR, analysis.known)
    told += rows.drop("record_uid").toJSON().collect() + shown
    assert not [line for line in told if "@corp.example.com" in line or "11010119900101" in line or "张伟" in line]


def test_hot_groups_are_salted(spark, monkeypatch):
    """A third of all rows in one key: the salted join must return the same as the broadcast."""
    rows = spark.range(3000).select(
        F.col("id").alias("ordinal"), F.col("id").cast("string").alias("record_uid"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("k%d", F.col("id") % 1400)).alias("k"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.format_string("p%d", F.col("id") % 1300)).alias("p"),
    )
    plain = sorted(map(tuple, groups.marks(rows, ["k", "p"], ["k"], ["p"])[0].collect()))
    monkeypatch.setattr(groups, "BROADCAST_GROUPS", -1)
    salted = sorted(map(tuple, groups.marks(rows, ["k", "p"], ["k"], ["p"])[0].collect()))
    assert plain == salted
    surplus = {r[0] for r in plain if r[1]}
    seen, brute = set(), set()
    for r in rows.orderBy("ordinal").collect():
        (brute.add(r["ordinal"]) if (r["k"], r["p"]) in seen else seen.add((r["k"], r["p"])))
    assert surplus == brute


def test_long_cells_travel_as_digests(spark):
    long = "word " * 400
    df = spark.createDataFrame([(long,), (long,), ("short",), ("9" * 200,)], "t string")
    counts = profile.cell_counts(df, ["t"]).collect()
    assert {(r["is_long"], r["cnt"], r["chars"]) for r in counts} == {(True, 2, 2000), (False, 1, 5), (False, 1, 200)}
    assert max(len(r["value"]) for r in counts) == 200
    facts = profile.column_facts(gate.written(profile.cell_counts(df, ["t"]), "c"))
    row = facts.first()
    assert (row["distinct_count"], row["max_length"], row["shapes"]) == (3, 2000, {patterns.TEXT: 3, patterns.DIGITS: 1})
    assert hashing.row_digest(["t"]) is not None


def test_published_values_are_whole_texts(spark):
    """Counts and top values against plain Python: no digest, ties by the whole text whatever its length."""
    head = "x" * 128
    texts = [head, head + " b", head + " a", head + " a", head + " c", "x" * 127, "y", None, " ", "word " * 40, "z " * 500, "z " * 500]
    df = spark.createDataFrame([(t, "same " * 60) for t in texts], "t string, u string")
    plain = {}
    for t in texts:
        plain[t] = plain.get(t, 0) + 1
    counted = {(r["value"], r["cnt"]) for r in profile.value_counts(df, ["t"]).collect()}
    assert counted == set(plain.items())
    order = sorted(((-n, t) for t, n in plain.items() if t and t.strip()))
    for k in (1, 2, 3, 4, 5, 6, 20):
        top = profile.top_values(df, profile.cell_counts(df, ["t", "u"]), k).orderBy("column", "rank").collect()
        assert [(r["rank"], -r["cnt"], r["value"]) for r in top if r["column"] == "t"] == [(i + 1, *o) for i, o in enumerate(order[:k])]
        assert [(r["value"], r["cnt"]) for r in top if r["column"] == "u"] == [("same " * 60, len(texts))]
    empty = df.limit(0)
    assert profile.top_values(empty, profile.cell_counts(empty, ["t"])).count() == 0
