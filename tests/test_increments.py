"""The gate by batches equals the gate on the whole table."""

import pytest
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.operators import release
from sluice.plans import gate
from sluice.queries import feeds
from sluice.session import written
from sluice.sources import files
from sluice.streaming.increments import MARK, Increments


@pytest.fixture(scope="module")
def feed(spark):
    return written(feeds.orders_feed(spark, "/root/testdata/sf0.001"), "feed")


def shown(found):
    return sorted((r["finding_id"], r["affected_record_count"], r["affected_cell_count"], r["authorization_mode"]) for r in found.collect())


def test_batches_equal_one_run(spark, feed, tmp_path):
    parts = Increments(spark, feeds.ORDER_CONTRACT, str(tmp_path / "gate"))
    for batch in range(3):
        parts.take(feed.where(F.pmod(F.xxhash64("ordinal"), F.lit(3)) == batch), batch)
        if batch == 0:
            seen = feed.where(F.pmod(F.xxhash64("ordinal"), F.lit(3)) == 0)
            assert shown(parts.findings()) == shown(gate.analyse(seen, feeds.ORDER_CONTRACT).findings)
    whole = shown(gate.analyse(feed, feeds.ORDER_CONTRACT).findings)
    assert shown(parts.findings()) == whole
    assert parts.scope().collect() == release.scope_fingerprint(feed).collect()
    # A batch that comes again changes nothing; an attempt without its mark is replaced.
    parts.take(feed, 1)
    assert shown(parts.findings()) == whole
    files.delete(spark, f"{tmp_path}/gate/batch=2/{MARK}")
    assert shown(parts.findings()) != whole
    parts.take(feed.where(F.pmod(F.xxhash64("ordinal"), F.lit(3)) == 2), 2)
    assert shown(parts.findings()) == whole and parts.scope().first()["members"] == feed.count()


def test_stream_of_files(spark, feed, tmp_path):
    for n in range(3):
        feed.where(F.col("ordinal") % 3 == n).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    parts = Increments(spark, feeds.ORDER_CONTRACT, str(tmp_path / "gate"))
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # the second start finds nothing new
        parts.start(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert len(parts.batches()) == 3
    assert shown(parts.findings()) == shown(gate.analyse(feed, feeds.ORDER_CONTRACT).findings)


def test_needs_a_contract(spark, tmp_path):
    with pytest.raises(ValueError):
        Increments(spark, Contract(), str(tmp_path))
    assert Increments(spark, feeds.ORDER_CONTRACT, str(tmp_path / "none")).batches() == []
