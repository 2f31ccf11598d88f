"""Runs kept on storage: staged whole, named by their content, published by a pointer, verified from the folder alone.

``base/runs/<root>`` holds a run's artifacts, each dealt into buckets by record, the hash trees of their rows
and a manifest. The folder's name is the hash of the manifest, and the manifest names the root of every tree,
so nothing in the folder can change unseen. ``base/CURRENT`` is a small file that names the published run; it
is replaced by one rename, and only for a run that isn't BLOCKED. A failure at any earlier point leaves the
last release as it was.

A tree's leaf is the sha256 of the sorted digests of the records whose key starts with a prefix; a leaf holds
some LEAF_ROWS records, whatever the table's size, and a node is the hash of its 16 children. Verification
compares trees from stored rows with the stored ones and names the prefixes that differ.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.contract import Contract, canonical_json
from sluice.functions.hashing import row_digest
from sluice.operators import decide
from sluice.operators.decide import GovernanceError
from sluice.plans import gate
from sluice.session import scratch, together
from sluice.sources import files

LEAF_ROWS = 4096
BUCKET_ROWS = 1_000_000
NODES = "artifact string, depth int, prefix string, members bigint, digest string"
RECORDS = ("source", "candidate", "release", "ledger")  # artifacts whose rows belong to a record
FORMATS = {"ledger": "json"}  # the others are Parquet
JSON_COMPRESSION = "gzip"  # a bucket is one file of BUCKET_ROWS at most, so it needn't be splittable
Check = tuple[str, bool, Any, Any]


def cell_text(name: str, kind: str) -> Column:
    """A column as text; nested values as JSON."""
    cell = F.col(f"`{name}`")
    return F.to_json(cell, {"ignoreNullFields": "false"}) if kind.startswith(("array", "map", "struct")) else cell.cast("string")


def text_cells(df: DataFrame) -> DataFrame:
    return df.select(*[cell_text(name, kind).alias(name) for name, kind in df.dtypes])


def keys(df: DataFrame, artifact: str) -> Column:
    """What deals the rows out: the record's id, or a digest of the row where it belongs to no record."""
    return F.col("record_uid") if artifact in RECORDS else F.sha2(F.to_json(F.struct(*[cell_text(n, k).alias(n) for n, k in df.dtypes]), {"ignoreNullFields": "false"}), 256)


def depth_for(rows: int, size: int) -> int:
    """Hex digits of a key so that a prefix covers about ``size`` rows at most; one at least."""
    depth = 1
    while rows > size << 4 * depth:
        depth += 1
    return depth


def row_tree(df: DataFrame, artifact: str, depth: int) -> DataFrame:
    """All nodes (artifact, depth, prefix, members, digest) of a table's hash tree; no rows for an empty table."""
    cells = text_cells(df.withColumn("__prefix", F.substring(keys(df, artifact), 1, depth)))
    # Digests travel as bytes, which sort as their hexadecimal spelling does.
    rows = cells.select(F.col("__prefix").alias("prefix"), F.unhex(row_digest(df.columns)).alias("digest"))
    members = F.array_join(F.transform(F.array_sort(F.collect_list("digest")), lambda d: F.lower(F.hex(d))), "")
    level = rows.groupBy("prefix").agg(F.count("*").alias("members"), F.sha2(members, 256).alias("digest"))
    out = level.select(F.lit(depth).alias("depth"), "prefix", "members", "digest")
    for shorter in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        node = F.sha2(F.concat(F.lit("node:"), F.array_join(F.transform(children, lambda c: c["digest"]), "")), 256)
        level = level.groupBy(F.substring("prefix", 1, shorter).alias("above")).agg(F.sum("members").alias("members"), node.alias("digest"))
        level = level.withColumnRenamed("above", "prefix")
        out = out.unionByName(level.select(F.lit(shorter).alias("depth"), "prefix", "members", "digest"))
    return out.select(F.lit(artifact).alias("artifact"), "depth", "prefix", "members", "digest")


@dataclass(frozen=True)
class StoredRun:
    """A run's folder and what its manifest says."""

    folder: str
    manifest: dict[str, Any]

    @property
    def root(self) -> str:
        return self.folder.rsplit("/", 1)[-1]

    @property
    def contract(self) -> Contract:
        return Contract.from_dict(self.manifest["contract"])

    def path(self, artifact: str) -> str:
        return f"{self.folder}/artifacts/{artifact}"

    def table(self, spark: SparkSession, artifact: str, bucket: str | None = None) -> DataFrame:
        """A stored artifact, or the rows of one bucket without reading any other."""
        entry = self.manifest["artifacts"][artifact]
        rows = spark.read.schema(entry["schema"] + ", `__bucket` string").format(entry["format"]).load(self.path(artifact))
        return (rows if bucket is None else rows.where(F.col("__bucket") == bucket)).drop("__bucket")

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(NODES).parquet(f"{self.folder}/trees")


def stage(outcome: gate.Release, decisions: DataFrame, base: str, *, proposals: DataFrame | None = None, depth: int | None = None) -> StoredRun:
    """Write a run's artifacts, trees and manifest aside, then give the folder its name in one step."""
    spark = outcome.table.sparkSession
    plan = outcome.plan
    artifacts = {
        "source": plan.analysis.source, "findings": plan.analysis.findings, "decisions": decisions, "validations": outcome.validations(),
        "candidate": outcome.candidate, "release": outcome.table, "ledger": outcome.ledger,
    }
    if proposals is not None:
        artifacts["proposals"] = proposals
    folder = f"{base}/staging-{uuid.uuid4().hex}"

    def save(name: str) -> tuple[str, dict[str, Any]]:
        df = artifacts[name]
        rows = plan.totals["records"]
        width = depth_for(rows, BUCKET_ROWS) if name in RECORDS else 1
        kind = FORMATS.get(name, "parquet")
        dealt = df.withColumn("__bucket", F.substring(keys(df, name), 1, width)).repartition("__bucket")
        writer = dealt.write.partitionBy("__bucket").format(kind)
        (writer.option("compression", JSON_COMPRESSION) if kind == "json" else writer).save(f"{folder}/artifacts/{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return name, {"format": kind, "schema": schema, "bucket_digits": width, "depth": max(width, depth or depth_for(rows, LEAF_ROWS)) if name in RECORDS else 1}

    entries = dict(together(*[lambda n=name: save(n) for name in artifacts]))
    run = StoredRun(folder, {"artifacts": entries})
    trees = None
    for name, entry in entries.items():
        nodes = row_tree(run.table(spark, name), name, entry["depth"])
        trees = nodes if trees is None else trees.union(nodes)
    trees.write.parquet(f"{folder}/trees")
    tops = {r["artifact"]: r for r in run.nodes(spark).where("depth = 0").collect()}
    for name, entry in entries.items():
        top = tops.get(name)
        entry |= {"members": top["members"] if top else 0, "root": top["digest"] if top else ""}
    manifest = {
        "artifacts": entries, "contract": plan.analysis.contract.as_dict(), "hashes": gate.stored_hashes(outcome),
        "run": {k: v for k, v in outcome.manifest().first().asDict().items()}, "revision": plan.changes.revision,
        "blocking_unresolved": sorted(plan.changes.blocking_unresolved), "status": outcome.status,
    }
    text = canonical_json(manifest)
    files.write_text(spark, f"{folder}/manifest.json", text)
    named = f"{base}/runs/{hashlib.sha256(text.encode()).hexdigest()}"
    if files.exists(spark, named):  # the same run was staged before
        files.delete(spark, folder)
    else:
        system, at = files.located(spark, f"{base}/runs")
        system.mkdirs(at)
        files.move(spark, folder, named)
    return load(spark, named)


def load(spark: SparkSession, folder: str) -> StoredRun:
    return StoredRun(folder, json.loads(files.read_text(spark, f"{folder}/manifest.json")))


def switch(spark: SparkSession, base: str, root: str) -> None:
    """Publish a staged run: the pointer is replaced by one rename. A BLOCKED, altered or unstaged run is refused."""
    folder = f"{base}/runs/{root}"
    if not files.exists(spark, f"{folder}/manifest.json"):
        raise GovernanceError("RUN_NOT_STAGED", root, None)
    text = files.read_text(spark, f"{folder}/manifest.json")
    if hashlib.sha256(text.encode()).hexdigest() != root:
        raise GovernanceError("MANIFEST_CHANGED", hashlib.sha256(text.encode()).hexdigest(), root)
    status = json.loads(text)["status"]
    if status == "BLOCKED":
        raise GovernanceError("RELEASE_BLOCKED", status, "PASS or CONDITIONAL_PASS")
    aside = f"{base}/pointer-{uuid.uuid4().hex}"
    files.write_text(spark, aside, canonical_json({"root": root, "status": status}))
    files.move(spark, aside, f"{base}/CURRENT", replace=True)


def current(spark: SparkSession, base: str) -> StoredRun | None:
    """The published run."""
    if not files.exists(spark, f"{base}/CURRENT"):
        return None
    return load(spark, f"{base}/runs/{json.loads(files.read_text(spark, f'{base}/CURRENT'))['root']}")


def differences(spark: SparkSession, run: StoredRun, bucket: dict[str, str] | None = None) -> DataFrame:
    """(artifact, prefix, state, stored, found): leaves whose rows aren't those of the stored tree.

    ``bucket`` limits the look to one bucket per named artifact; no other bucket is read.
    """
    out = None
    stored = run.nodes(spark)
    for name, entry in run.manifest["artifacts"].items():
        if bucket is not None and name not in bucket:
            continue
        part = (bucket or {}).get(name)
        kept = stored.where((F.col("artifact") == name) & (F.col("depth") == entry["depth"]))
        if part is not None:
            kept = kept.where(F.col("prefix").startswith(part))
        kept = kept.select("prefix", F.col("members").alias("stored"), F.col("digest").alias("was"))
        if files.exists(spark, run.path(name)):
            now = row_tree(run.table(spark, name, part), name, entry["depth"]).where(F.col("depth") == entry["depth"])
            now = now.select("prefix", F.col("members").alias("found"), F.col("digest").alias("is"))
        else:
            now = spark.createDataFrame([], "prefix string, found bigint, is string")
        both = kept.join(now, "prefix", "full").where(~F.col("was").eqNullSafe(F.col("is")))
        state = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").otherwise("altered")
        rows = both.select(
            F.lit(name).alias("artifact"), "prefix", state.alias("state"), F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("found", F.lit(0)).alias("found"),
        )
        out = rows if out is None else out.union(rows)
    return out


def verify(spark: SparkSession, folder: str, *, reexecute: bool = True) -> list[Check]:
    """Checks of a stored run, from its folder alone: name, trees, artifacts, contract, and the run executed again."""
    text = files.read_text(spark, f"{folder}/manifest.json")
    run = StoredRun(folder, json.loads(text))
    manifest = run.manifest
    checks: list[Check] = []

    def check(name: str, observed: Any, expected: Any) -> None:
        checks.append((name, observed == expected, observed, expected))

    check("MANIFEST_HASH", hashlib.sha256(text.encode()).hexdigest(), run.root)
    check("CONTRACT_HASH", run.contract.hash, manifest["hashes"]["CONTRACT_HASH"])
    tops = {r["artifact"]: r["digest"] for r in run.nodes(spark).where("depth = 0").collect()}
    check("TREE_ROOTS", {n: tops.get(n, "") for n in manifest["artifacts"]}, {n: e["root"] for n, e in manifest["artifacts"].items()})
    wrong = {r["artifact"]: r["n"] for r in differences(spark, run).groupBy("artifact").agg(F.count("*").alias("n")).collect()}
    for name in manifest["artifacts"]:
        check(f"{name.upper()}_ROWS", wrong.get(name, 0), 0)
    if not reexecute:
        return checks
    if wrong.keys() & {"source", "decisions", "proposals"}:
        check("REEXECUTION", "refused: its inputs were altered", "executed")
        return checks
    with scratch(spark):
        decisions = run.table(spark, "decisions")
        proposals = run.table(spark, "proposals") if "proposals" in manifest["artifacts"] else None
        analysis = gate.analyse(run.table(spark, "source"), run.contract, proposals=proposals)
        again = gate.execute(gate.dry_run(analysis, decisions, manifest["revision"]))
        for name, value in gate.stored_hashes(again).items():
            check(f"AGAIN_{name}", value, manifest["hashes"][name])
        check("AGAIN_STATUS", again.status, manifest["status"])
    return checks


def release_run(
    source: DataFrame, contract: Contract, base: str, *, decisions: DataFrame | None = None, proposals: DataFrame | None = None, revision: int = 1,
) -> StoredRun:
    """Analyse, decide (by default as the contract authorizes), execute, stage and publish; intermediates are deleted at the end.

    A BLOCKED run is staged for inspection, not published: ``switch`` raises and the last release stays.
    """
    spark = source.sparkSession
    with scratch(spark):
        analysis = gate.settled(gate.analyse(source, contract, proposals=proposals))
        given = decisions if decisions is not None else decide.default_decisions(analysis.findings)
        run = stage(gate.execute(gate.dry_run(analysis, given, revision)), given, base, proposals=proposals)
    switch(spark, base, run.root)
    return run
