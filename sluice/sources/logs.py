"""JSON lines in and out: event and call logs, the run catalogue, reports and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import runs
from sluice.session import written
from sluice.sources import files

META_SCHEMA = (
    "run_id string, name string, sample_id string, lifecycle string, created_at timestamp, run_revision int, contract_source string"
)
SNAPSHOT_HIDDEN = ("record_uid", "display_key", "before", "after", "mapping", "top_values", "members")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_events(spark: SparkSession, events: DataFrame, path: str, schema: str) -> None:
    """Append events with the next sequence numbers of their runs; only the log's runs among the new events are looked at."""
    last = None
    if files.exists(spark, path):
        new = events.select("run_id").distinct()
        log = spark.read.schema(schema).json(path).join(new, "run_id", "left_semi")
        last = written(log.groupBy("run_id").agg(F.max("seq").alias("last_seq")), "last-seq")  # read before the log grows
    append_log(runs.sequenced(events, "run_id", "ts", "message", last), path)


def run_catalogue(spark: SparkSession, base: str) -> DataFrame:
    """All readable run descriptions below ``base``, newest first; corrupt ones are skipped."""
    metas = spark.read.schema(META_SCHEMA).option("mode", "DROPMALFORMED").json(f"{base}/*/meta.json")
    return metas.filter(F.col("run_id").isNotNull()).orderBy(F.desc("created_at"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON; the commit protocol makes it appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def audit_bundle(parts: dict[str, DataFrame], run_id: str) -> DataFrame:
    """(run_id, part, payload): every record of every table of a run as one JSON line."""
    out = None
    for name, df in parts.items():
        lines = df.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("payload"))
        out = lines if out is None else out.unionByName(lines)
    return out


def snapshot(df: DataFrame) -> DataFrame:
    """A table without rows' identities, values and payloads; aggregates stay."""
    return df.drop(*[c for c in SNAPSHOT_HIDDEN if c in df.columns])


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a release or candidate table."""
    writer = df.write.mode("errorifexists")
    writer.option("header", "true").option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path)
