"""The gate on a table that grows by batches: every batch leaves summaries that merge, findings come from the summaries.

A batch leaves its rows, digests of its records and keys, counts of its unlisted values, facts of its columns and
sums for the fingerprint. A mark written last makes it count; a batch that comes again is left alone, and what an
attempt without a mark left behind is replaced. What the rules on a row say depends on what is known of all
rows, so claims are kept under a hash of that knowledge: a batch is judged again only after the knowledge changed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.contract import Contract, canonical_json
from sluice.functions.hashing import bucket_sums, sealed_sums
from sluice.operators import detect, groups, semantic
from sluice.operators.detect import Knowledge
from sluice.session import scratch, together
from sluice.sources import files

MARK = "taken"


class Increments:
    """Batches of (ordinal, record_uid, text columns) below ``folder``; ordinals are unique over all batches."""

    def __init__(self, spark: SparkSession, contract: Contract, folder: str):
        if contract.observational:
            raise ValueError("batches are judged by a contract; without one the rules depend on all rows at once")
        self.spark, self.contract, self.folder = spark, contract, folder

    def take(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch once, whatever happens to earlier attempts; fits ``foreachBatch``."""
        path = f"{self.folder}/batch={batch_id}"
        if files.exists(self.spark, f"{path}/{MARK}"):
            return
        files.delete(self.spark, path)
        rows.write.parquet(f"{path}/rows")
        rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
        columns = detect.data_columns(rows)
        parts = {
            "view": groups.identity_view(rows, columns, self.keys(columns)),
            "unlisted": semantic.unlisted_counts(rows, self.contract, self.contract.named("sensitive")),
            "scan": detect.scan_row(rows, self.contract, columns),
            "sums": bucket_sums(rows, "record_uid"),
        }
        together(*[lambda n=name, d=df: d.write.parquet(f"{path}/{n}") for name, df in parts.items()])
        files.write_text(self.spark, f"{path}/{MARK}", canonical_json({"columns": columns, "schema": rows.schema.simpleString()}))

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def keys(self, columns: list[str]) -> dict[str, list[str]]:
        contract = self.contract
        key = contract.business_key if all(k in columns for k in contract.business_key) else []
        unique = [c for c in contract.named("unique") if c in columns and c not in contract.business_key]
        return ({"business_key": key} if key else {}) | {f"unique_{name}": [name] for name in unique}

    def batches(self) -> list[str]:
        """Folders of the batches that count."""
        if not files.exists(self.spark, self.folder):
            return []
        system, at = files.located(self.spark, self.folder)
        found = sorted(str(status.getPath().toString()) for status in system.listStatus(at))
        return [path for path in found if files.exists(self.spark, f"{path}/{MARK}")]

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{path}/{part}" for path in self.batches()])

    def known(self) -> Knowledge:
        """What one pass over all rows would know of the columns."""
        known = Knowledge(columns=detect.data_columns(self.read("rows")))
        detect.read_scan(detect.merged_scan(self.read("scan")), self.contract, known)
        withheld = known.withheld(self.contract)
        counts = self.read("unlisted").groupBy("column", "value").agg(F.sum("cnt").alias("cnt"))
        return detect.learn_values(counts.filter(~F.col("column").isin(withheld)) if withheld else counts, self.contract, known)

    def claimed(self, known: Knowledge) -> DataFrame:
        """Rows claimed by rules on the row, judged again only where the knowledge is new to a batch."""
        name = "claims-" + hashlib.sha256(canonical_json([self.contract.hash, known.mapping, known.candidates, known.slash]).encode()).hexdigest()[:24]
        missing = [path for path in self.batches() if not files.exists(self.spark, f"{path}/{name}/_SUCCESS")]
        for path in missing:
            rows = self.spark.read.parquet(f"{path}/rows")
            detect.row_claimed(rows, self.contract, known).write.mode("overwrite").parquet(f"{path}/{name}")
        return self.read(name)

    def findings(self) -> DataFrame:
        """Findings over all batches so far: those of one run over all their rows."""
        with scratch(self.spark):
            known = self.known()
            marked, _ = groups.view_marks(self.read("view"))
            judged = detect.with_groups(self.claimed(known), marked)
            found = detect.findings(judged, self.contract, known).collect()  # bounded by the columns
            schema = detect.findings(judged, self.contract, known).schema
        return self.spark.createDataFrame(found, schema)

    def scope(self) -> DataFrame:
        """(members, fingerprint) of all records."""
        sums = self.read("sums").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "l0", "l1", "l2")])
        return sealed_sums(sums)
