"""Findings and decisions to dispositions and typed actions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.functions import dates
from sluice.operators import detect
from sluice.operators.detect import Knowledge
from sluice.session import together

# Order of preference of a default decision, and the disposition per outcome.
DEFAULT_PRIORITY = (detect.APPROVE, detect.EXCLUDE, detect.QUARANTINE, detect.FLAG, detect.REJECT)
DISPOSITION_OF = {
    detect.APPROVE: "HUMAN_ACTION_APPROVED",
    detect.QUARANTINE: "QUARANTINED",
    detect.EXCLUDE: "EXCLUDED",
    detect.FLAG: "FLAGGED_FOR_REVIEW",
    detect.REJECT: "PROPOSAL_REJECTED",
}
REFUSALS = ("UNRESOLVED_FINDINGS", "DECISION_REVISION_MISMATCH", "OUTCOME_NOT_ALLOWED", "DUPLICATE_DECISION")


class GovernanceError(ValueError):
    def __init__(self, code: str, observed: Any = None, expected: Any = None) -> None:
        super().__init__(f"{code}: observed {observed!r}, expected {expected!r}")
        self.code, self.observed, self.expected = code, observed, expected


def needs_decision() -> Column:
    return ~F.col("authorization_mode").isin(detect.POLICY, detect.FORBIDDEN)


def default_decisions(found: DataFrame, revision: int = 1, by: list[str] | None = None) -> DataFrame:
    """One sensible decision per finding that needs one: the most preferred allowed outcome."""
    by = by or []
    priority = F.array(*[F.lit(o) for o in DEFAULT_PRIORITY])
    best = Window.partitionBy(*by, "finding_id").orderBy("preference")
    return (
        found.filter(needs_decision())
        .select(*by, "finding_id", F.explode("allowed_outcomes").alias("outcome"))
        .withColumn("preference", F.array_position(priority, F.col("outcome")))
        .filter("preference > 0")
        .withColumn("pick", F.row_number().over(best))
        .filter("pick = 1")
        .select(*by, "finding_id", "outcome", F.lit(revision).alias("run_revision"))
    )


def unresolved(found: DataFrame, decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = [*(by or []), "finding_id"]
    return found.filter(needs_decision()).join(decisions, keys, "left_anti").select(*keys)


def duplicate_decisions(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = [*(by or []), "finding_id"]
    return decisions.groupBy(*keys).agg(F.count("*").alias("decisions")).filter("decisions > 1")


def surviving_decisions(decisions: DataFrame, found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """After a re-analysis, decisions of findings that vanished are dropped."""
    return decisions.join(found, [*(by or []), "finding_id"], "left_semi")


def dispositions(found: DataFrame, decisions: DataFrame, revision: int | Column = 1, by: list[str] | None = None) -> DataFrame:
    """findings left join decisions: the disposition, or the reason why there is none (``refusal``)."""
    keys = [*(by or []), "finding_id"]
    joined = found.join(decisions.select(*keys, "outcome", "run_revision"), keys, "left")
    outcome = F.col("outcome")
    mode = F.col("authorization_mode")
    open_case = needs_decision()
    wrong_revision = F.col("run_revision") != revision
    not_allowed = ~F.array_contains("allowed_outcomes", outcome)
    refusal = (
        F.when(open_case & outcome.isNull(), "UNRESOLVED_FINDINGS")
        .when(open_case & wrong_revision, "DECISION_REVISION_MISMATCH")
        .when(open_case & not_allowed, "OUTCOME_NOT_ALLOWED")
    )
    human = F.when(F.lit(False), "")
    for name, label in DISPOSITION_OF.items():
        human = human.when(outcome == name, label)
    label = (
        F.when(mode == detect.FORBIDDEN, "NOT_ACTIONABLE")
        .when((mode == detect.POLICY) & (outcome == detect.REJECT), "PROPOSAL_REJECTED")
        .when(mode == detect.POLICY, "POLICY_ACTION_APPROVED")
        .when(refusal.isNull(), human)
    )
    kept = [c for c in found.columns if c not in ("disposition", "outcome", "run_revision")]
    out = joined.select(*kept, "outcome", "run_revision", label.alias("disposition"), refusal.alias("refusal"))
    blocked = F.col("blocking") & (F.col("disposition") == "PROPOSAL_REJECTED")
    return out.withColumn("blocking_unresolved", F.coalesce(blocked, F.lit(False)))


def late_decisions(decisions: DataFrame, current: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split decisions into those of the current revision and the stale rest."""
    joined = decisions.join(current.withColumnRenamed("run_revision", "current_revision"), by, "left")
    fresh = F.coalesce(F.col("run_revision") == F.col("current_revision"), F.lit(False))
    return joined.filter(fresh).drop("current_revision"), joined.filter(~fresh)


@dataclass(frozen=True)
class Action:
    action_type: str
    finding_id: str
    authorization_source: str
    authorization_ref: str
    column: str | None = None
    source_format: str | None = None
    target_format: str | None = None
    mapping: dict[str, str] = field(default_factory=dict)


@dataclass
class ChangeSet:
    """The typed change set of one run; members stay in the annotated rows."""

    actions: list[Action]
    dispositions: dict[str, str]
    blocking_unresolved: list[str]
    revision: int

    def by_type(self, kind: str) -> list[Action]:
        return [action for action in self.actions if action.action_type == kind]

    @property
    def excluded_columns(self) -> list[str]:
        return sorted({a.column for a in self.by_type("EXCLUDE_COLUMN_FROM_RELEASE")})

    @property
    def edits(self) -> list[Action]:
        return [a for a in self.actions if a.action_type in ("NORMALIZE_CATEGORY", "STANDARDIZE_DATE_FORMAT")]


def mapping_of(finding_id: str, column: str, contract: Contract, known: Knowledge) -> dict[str, str]:
    if finding_id.startswith("SEM-"):
        return dict(known.mapping.get(column, {}))
    tokens = contract.tokens(column)
    return {a: t for a, t in contract.fields[column].aliases.items() if a not in tokens and a.strip()}


def proposed_actions(row: Any, source: str, ref: str, contract: Contract, known: Knowledge, formats: list[str]) -> list[Action]:
    kind, column = row["proposed_action"], row["column"]
    if kind == "STANDARDIZE_DATE_FORMAT":
        rule = contract.fields[column]
        default = dates.DEFAULT_DATETIME_FORMAT if rule.type == "datetime" else dates.DEFAULT_DATE_FORMAT
        return [
            Action(kind, row["finding_id"], source, ref, column, fmt, rule.format or default)
            for fmt in rule.accept_formats if fmt in formats
        ]
    if kind == "NORMALIZE_CATEGORY":
        return [Action(kind, row["finding_id"], source, ref, column, mapping=mapping_of(row["finding_id"], column, contract, known))]
    return [Action(kind, row["finding_id"], source, ref)] if kind else []


def change_set(
    found: DataFrame, decisions: DataFrame, contract: Contract, known: Knowledge, claim_counts: DataFrame, revision: int = 1
) -> ChangeSet:
    """Build the change set, or refuse. Findings are bounded by the number of columns."""
    double, decided, seen_formats = together(
        lambda: [row["finding_id"] for row in duplicate_decisions(decisions).collect()],
        lambda: dispositions(found, decisions, revision).collect(),
        lambda: claim_counts.filter(F.col("finding_id").startswith("FMT-")).collect(),
    )
    if double:
        raise GovernanceError("OUTCOME_NOT_ALLOWED", double, "one decision per finding")
    rows = sorted(decided, key=lambda row: (row["detector_rank"], row["column_rank"]))
    for code in ("DECISION_REVISION_MISMATCH", "OUTCOME_NOT_ALLOWED", "UNRESOLVED_FINDINGS"):
        refused = [row["finding_id"] for row in rows if row["refusal"] == code]
        if refused:
            raise GovernanceError(code, refused, [])
    formats: dict[str, list[str]] = {}
    for row in seen_formats:
        formats.setdefault(row["finding_id"], []).append(row["detail"])
    actions: list[Action] = []
    for row in rows:
        fid, label = row["finding_id"], row["disposition"]
        seen = formats.get(fid, [])
        if label == "POLICY_ACTION_APPROVED":
            ref = f"{contract.id}@{contract.version}:{fid}"
            actions += proposed_actions(row, "POLICY", ref, contract, known, seen)
        elif label == "HUMAN_ACTION_APPROVED":
            actions += proposed_actions(row, "HUMAN", f"decision:{fid}", contract, known, seen)
        elif label == "QUARANTINED":
            actions.append(Action("QUARANTINE_RECORDS", fid, "HUMAN", f"decision:{fid}"))
        elif label == "EXCLUDED":
            actions.append(Action("EXCLUDE_COLUMN_FROM_RELEASE", fid, "HUMAN", f"decision:{fid}", row["column"]))
        elif label == "FLAGGED_FOR_REVIEW":
            actions.append(Action("FLAG_FOR_REVIEW", fid, "HUMAN", f"decision:{fid}"))
    return ChangeSet(
        actions,
        {row["finding_id"]: row["disposition"] for row in rows},
        [row["finding_id"] for row in rows if row["blocking_unresolved"]],
        revision,
    )


ACTION_SCHEMA = (
    "action_rank int, action_type string, finding_id string, column string, source_format string, "
    "target_format string, mapping map<string,string>, authorization_source string, authorization_ref string"
)


def action_table(changes: ChangeSet, spark) -> DataFrame:  # noqa: ANN001
    rows = [
        (i, a.action_type, a.finding_id, a.column, a.source_format, a.target_format, a.mapping, a.authorization_source, a.authorization_ref)
        for i, a in enumerate(changes.actions)
    ]
    return spark.createDataFrame(rows, ACTION_SCHEMA)
