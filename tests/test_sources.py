"""Delimited intake: encodings, delimiters, refusals, ordinals; logs and sinks."""

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.plans import gate
from sluice.session import BATCH_CONF
from sluice.sources import blocks, delimited, logs
from sluice.sources.delimited import IntakeError


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


TEXT = "id,名称\n1,北京\n2,上海\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
def test_encodings(spark, tmp_path, encoding):
    content = TEXT.encode(encoding)
    table, layout, digest = delimited.intake(spark, put(tmp_path, "a.csv", content))
    assert layout.columns == ["id", "名称"]
    assert [tuple(r) for r in table.orderBy("ordinal").select("ordinal", "id", "名称").collect()] == [(0, "1", "北京"), (1, "2", "上海")]
    assert digest == hashlib.sha256(content).hexdigest()
    uid = hashlib.sha256(f"{digest}:1".encode()).hexdigest()[:24]
    assert table.filter("ordinal = 1").first()["record_uid"] == uid


@pytest.mark.parametrize("sep", ["\t", ";", ","])
def test_delimiters(spark, tmp_path, sep):
    layout = delimited.detect_layout(spark, put(tmp_path, "a.csv", f"a{sep}b\n1{sep}2\n"))
    assert (layout.delimiter, layout.columns) == (sep, ["a", "b"])


@pytest.mark.parametrize(
    ("content", "code"),
    [
        (b"", "CSV_EMPTY"), ("a,,c\n1,2,3\n", "CSV_HEADER_INVALID"), ("a,b,a\n1,2,3\n", "CSV_DUPLICATE_COLUMNS"),
        ("a,b\n", "CSV_NO_RECORDS"), (b"a,b\n\xff\xff,1\n", "CSV_ENCODING_UNSUPPORTED"),
    ],
)
def test_refusals(spark, tmp_path, content, code):
    with pytest.raises(IntakeError) as error:
        delimited.intake(spark, put(tmp_path, "a.csv", content))
    assert error.value.code == code


def test_malformed_rows(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.read_delimited(spark, path).collect()
    kept = delimited.read_delimited(spark, path, divert=True).cache()
    assert kept.filter(f"{delimited.CORRUPT} IS NOT NULL").count() == 2


def test_quotes_and_line_breaks(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n"say ""hi""","x, y"\n"two\nlines",""\n')
    layout = delimited.detect_layout(spark, path)
    assert layout.multi_line
    rows = [tuple(r) for r in delimited.read_delimited(spark, path, layout).collect()]
    assert rows == [('say "hi"', "x, y"), ("two\nlines", "")]


def test_wide_table(spark, tmp_path):
    names = [f"c{i}" for i in range(201)]
    content = ",".join(names) + "\n" + ",".join("v" for _ in names) + "\n"
    assert len(delimited.intake(spark, put(tmp_path, "a.csv", content))[0].columns) == 203


def test_blank_cell_is_a_record(spark, tmp_path):
    table = delimited.intake(spark, put(tmp_path, "a.csv", "only\nA\n \nA\n"))[0]
    counts, facts = gate.profiled(table)
    row = facts.first()
    assert (row["row_count"], row["empty"], row["distinct_count"]) == (3, 1, 1)
    found = {r["finding_id"]: r["affected_record_count"] for r in gate.analyse(table, Contract()).findings.collect()}
    assert found == {"DUP-EXACT": 1}


def test_blank_cells_in_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        put(tmp_path / "in", name, "only\nA\n \nonly\n")
    table = delimited.intake(spark, str(tmp_path / "in"))[0]
    assert sorted(r["only"] for r in table.collect()) == [" ", " ", "A", "A", "only", "only"]


def identities(spark, path, seal, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table, _, digest = delimited.intake(spark, path, seal=seal)
        return digest, sorted((r["n"], r["ordinal"], r["record_uid"]) for r in table.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seal", ["tree", "bytes", "content"])
def test_identity_is_the_same_for_every_split(spark, tmp_path, seal):
    (tmp_path / "in").mkdir()
    first, second = range(700), range(700, 4700)  # the shorter file comes first: splits are packed by size
    for name, rows in (("a.csv", first), ("b.csv", second)):
        put(tmp_path / "in", name, "n,t\n" + "".join(f"{i:05d},row {i}\n" for i in rows))
    path = str(tmp_path / "in")
    whole = identities(spark, path, seal, 1 << 27)
    assert [ordinal for _, ordinal, _ in whole[1]] == list(range(4700))
    assert whole == identities(spark, path, seal, 8000) == identities(spark, path, seal, 20_011)


def test_content_seal_sees_order_and_names(spark, tmp_path):
    texts = ("n,t\n1,a\n2,b\n", "n,t\n2,b\n1,a\n", "n,u\n1,a\n2,b\n", "n,t\r\n1,a\r\n2,b\r\n")
    sealed = [delimited.intake(spark, put(tmp_path, f"{i}.csv", text), seal="content")[2] for i, text in enumerate(texts)]
    assert len(set(sealed[:3])) == 3 and sealed[3] == sealed[0]


def test_single_column_over_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, rows in (("a.csv", range(30)), ("b.csv", range(30, 3000))):
        put(tmp_path / "in", name, "n\n" + "".join(f"{i:05d}\n" for i in rows))
    path = str(tmp_path / "in")
    whole = identities(spark, path, "bytes", 1 << 27)
    assert [(int(n), ordinal) for n, ordinal, _ in whole[1]] == [(i, i) for i in range(3000)]
    assert whole == identities(spark, path, "bytes", 997)


def test_ordinals_over_many_splits(spark, tmp_path):
    path = put(tmp_path, "big.csv", "n,t\n" + "".join(f"{i},row {i}\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = delimited.intake(spark, path)[0]
        assert table.filter("ordinal <> CAST(n AS BIGINT)").count() == 0
        assert table.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_event_log_sequence(spark, tmp_path):
    from sluice.streaming.logs import EVENT_SCHEMA, tail

    path = str(tmp_path / "events")

    def batch(names):
        rows = [("r1", n) for n in names]
        return spark.createDataFrame(rows, "run_id string, message string").select(
            "run_id", F.current_timestamp().alias("ts"), F.lit("PROFILING").alias("stage"), F.lit("COMPLETED").alias("status"), "message"
        )

    logs.append_events(spark, batch("ab"), path, EVENT_SCHEMA)
    logs.append_events(spark, batch("cd"), path, EVENT_SCHEMA)
    log = logs.read_log(spark, path, EVENT_SCHEMA)
    assert sorted((r["seq"], r["message"]) for r in log.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    query = tail(spark, path, 2).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["seq"] for r in spark.table("tail").collect()) == [3, 4]


def test_run_catalogue_skips_corrupt(spark, tmp_path):
    for name, text in (("r1", json.dumps({"run_id": "r1", "created_at": "2026-01-02T00:00:00Z"})), ("r2", "{broken"), ("r3", json.dumps({"run_id": "r3", "created_at": "2026-03-02T00:00:00Z"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(text)
    assert [r["run_id"] for r in logs.run_catalogue(spark, str(tmp_path)).collect()] == ["r3", "r1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u1", "a", 1)], "record_uid string, finding_id string, n int").coalesce(1)
    logs.publish(df, str(tmp_path / "out"), "csv")
    listed = delimited.file_hashes(spark, str(tmp_path / "out" / "*.csv")).collect()
    assert len(listed) == 1 and listed[0]["length"] > 0
    assert logs.snapshot(df).columns == ["finding_id", "n"]
    bundle = logs.audit_bundle({"ledger": df, "findings": df.select("finding_id")}, "r1").collect()
    assert {(r["part"], r["payload"]) for r in bundle} == {("ledger", '{"record_uid":"u1","finding_id":"a","n":1}'), ("findings", '{"finding_id":"a"}')}
    logs.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def plain_tree(data, leaf, fanout):
    """The same tree in plain Python over the whole content."""
    digests = [hashlib.sha256(data[i : i + leaf]).hexdigest() for i in range(0, len(data), leaf)]
    count = len(digests)
    while len(digests) > 1:
        digests = [hashlib.sha256(("node:" + "".join(digests[i : i + fanout])).encode()).hexdigest() for i in range(0, len(digests), fanout)]
    return len(data), count, digests[0]


@pytest.fixture
def splits(spark):
    """Sets the size of a split."""

    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_file_trees(spark, tmp_path, splits):
    rng = random.Random(2)
    files = {"one.bin": b"x", "breaks.bin": b"\n\n", "line.bin": b"y" * 5000 + b"\n"}
    for mark in (b"", b"\xef\xbb\xbf"):
        for end in (b"", b"\n"):
            body = b"\n".join(bytes(rng.choice(b'abc",\r\xff\x00') for _ in range(rng.choice([0, 3, 40, 700]))) for _ in range(30)) + b"z"
            files[f"{len(mark)}{len(end)}.bin"] = mark + body + end
    for name, content in files.items():
        put(tmp_path, name, content)
    for size, leaf, fanout in ((1 << 27, 64, 3), (1500, 64, 3), (1500, 1000, 2), (1 << 27, 1 << 20, 1024)):
        splits(size)
        got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["leaves"], r["root"]) for r in blocks.file_trees(spark, str(tmp_path), leaf, fanout).collect()}
        assert got == {name: plain_tree(content, leaf, fanout) for name, content in files.items()}


def test_file_beyond_the_limit_of_one_value(spark, tmp_path):
    content = "a,b\n" + "".join(f"{i},x\n" for i in range(2000))
    path = put(tmp_path, "a.csv", content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert delimited.intake(spark, path)[2] == hashlib.sha256(content.encode()).hexdigest()  # one leaf
        with pytest.raises(Exception, match="(?i)exceed|FAILED_READ"):
            delimited.intake(spark, path, seal="bytes")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_quoted_records_over_block_borders(spark, tmp_path, splits):
    rng = random.Random(6)
    rows = []
    for name, quoting in (("a.csv", csv.QUOTE_ALL), ("b.csv", csv.QUOTE_MINIMAL)):
        own = [["".join(rng.choice('ab",\n é') for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(3)] for _ in range(60)]
        own[7][1] = "\n" * 300 + '"'  # longer than a block
        text = io.StringIO()
        csv.writer(text, lineterminator="\n", quoting=quoting).writerows([["a", "b", "c"], *own])
        put(tmp_path, name, text.getvalue())
        rows += own
    found = []
    for size in (1 << 27, 900, 140):
        splits(size)
        table, _, digest = delimited.intake(spark, str(tmp_path))
        found.append((digest, [[r["a"] or "", r["b"] or "", r["c"] or ""] for r in table.orderBy("ordinal").collect()]))
    assert found[0][1] == rows and found[0] == found[1] == found[2]


def test_quoted_records_refuse_and_divert(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n"x\ny",1\n"p\nq",2,3\n\n"open')
    kept = delimited.read_delimited(spark, path, divert=True).collect()
    assert [(r["a"], r["b"]) for r in kept if r[delimited.CORRUPT] is None] == [("x\ny", "1")] and len(kept) == 3
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.read_delimited(spark, path).collect()
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.csv", 'a,b\n"x\ny",1\n')
    put(tmp_path / "in", "b.csv", 'a,c\n"x\ny",1\n')
    with pytest.raises(Exception, match="CSV_HEADER_MISMATCH"):
        delimited.intake(spark, str(tmp_path / "in"))


def test_many_tasks_for_a_file_with_quoted_breaks(spark, tmp_path, splits):
    path = put(tmp_path, "a.csv", "n,t\n" + "".join(f'{i},"two\nlines"\n' for i in range(3000)))
    splits(4000)
    assert blocks.lines(spark, path).rdd.getNumPartitions() > 5
    table = delimited.intake(spark, path)[0]
    assert table.filter("ordinal <> CAST(n AS BIGINT) OR t <> 'two\nlines'").count() == 0 and table.count() == 3000


@pytest.mark.parametrize("step", ["record_pieces", "leaf_pieces"])
def test_workers_hold_few_lines_at_once(spark, tmp_path, monkeypatch, step):
    make, most = getattr(blocks, step), blocks.BATCH_LINES

    def watched(given):
        run = make(given)

        def small(batches):
            for batch in batches:
                if batch.num_rows > most:
                    raise ValueError(f"{batch.num_rows} rows at once")
                yield batch

        return lambda batches: run(small(batches))

    monkeypatch.setattr(blocks, step, watched)
    before = spark.conf.get(BATCH_CONF)
    n = 4 * most
    path = put(tmp_path, "a.csv", "a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(n)))
    if step == "record_pieces":
        assert blocks.quoted_records(spark, path, "utf-8").count() == n + 1
    else:
        assert blocks.file_trees(spark, path).first()["leaves"] == 1
    assert spark.conf.get(BATCH_CONF) == before
