"""Apply a change set: edits, membership, ledger, release table and reconciliation.

Rows already carry their findings, so applying the approved actions is a projection: no join,
no shuffle, however many records are affected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.contract import Contract
from sluice.functions import dates, patterns
from sluice.functions.hashing import fingerprint, row_digest
from sluice.functions.text import is_blank
from sluice.operators.decide import Action, ChangeSet, GovernanceError
from sluice.operators.detect import Knowledge
from sluice.operators.groups import digest
from sluice.session import written

MEMBERSHIP_ORDER = ("QUARANTINED", "EXCLUDED", "FLAGGED")
LEDGER_ENTRY = (
    "struct<column:string,before:string,after:string,action_type:string,finding_id:string,"
    "authorization_source:string,authorization_ref:string>"
)


def after(column: str) -> str:
    return f"after:{column}"


def holds(finding_id: str) -> Column:
    return F.exists("claims", lambda c: c["finding_id"] == finding_id)


def in_scope(action: Action) -> Column:
    """Is the row a member of the action? Date actions own the cells of their source format."""
    if action.source_format is not None:
        return F.exists(
            "claims",
            lambda c: (c["finding_id"] == action.finding_id) & (c["detail"] == action.source_format),
        )
    return holds(action.finding_id)


def any_scope(actions: list[Action]) -> Column:
    ids = [a.finding_id for a in actions]
    return F.exists("claims", lambda c: c["finding_id"].isin(*ids)) if ids else F.lit(False)


def edited(column: Column, action: Action) -> Column:
    if action.action_type == "STANDARDIZE_DATE_FORMAT":
        return dates.reformat(column, action.source_format, action.target_format)
    pairs = [F.lit(x) for pair in action.mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def owner(actions: list[Action], attribute: str) -> Column:
    """Attribute of the last action that has the row in scope."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for action in reversed(actions):
        chain = chain.when(in_scope(action), getattr(action, attribute))
    return chain


def first_owner(actions: list[Action], attribute: str) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for action in actions:
        chain = chain.when(in_scope(action), getattr(action, attribute))
    return chain


def applied(annotated: DataFrame, changes: ChangeSet, known: Knowledge) -> DataFrame:
    """Source rows with ``after:<column>`` for edited columns and ``membership``."""
    missing = [a.column for a in changes.edits if a.column not in known.columns]
    if missing:
        raise GovernanceError("ACTION_SET_CHANGED", missing, known.columns)
    quarantined = any_scope(changes.by_type("QUARANTINE_RECORDS"))
    duplicate = any_scope(changes.by_type("EXCLUDE_EXACT_DUPLICATE_FROM_RELEASE"))
    flagged = any_scope(changes.by_type("FLAG_FOR_REVIEW"))
    results = {}
    for action in changes.edits:
        current = results.get(action.column, F.col(f"`{action.column}`"))
        results[action.column] = F.when(in_scope(action), edited(current, action)).otherwise(current)
    membership = F.when(quarantined, "QUARANTINED").when(duplicate, "EXCLUDED").when(flagged, "FLAGGED")
    return annotated.select(
        "*", *[expr.alias(after(name)) for name, expr in results.items()], membership.alias("membership")
    )


def edited_columns(changes: ChangeSet) -> list[str]:
    return list(dict.fromkeys(a.column for a in changes.edits))


def candidate(rows: DataFrame, changes: ChangeSet, known: Knowledge) -> DataFrame:
    """All rows with the approved edits."""
    done = edited_columns(changes)
    return rows.select(
        "ordinal", "record_uid",
        *[F.col(f"`{after(c)}`").alias(c) if c in done else F.col(f"`{c}`") for c in known.columns],
    )


def is_removed() -> Column:
    return F.coalesce(F.col("membership").isin("QUARANTINED", "EXCLUDED"), F.lit(False))


def release_table(rows: DataFrame, changes: ChangeSet, known: Knowledge) -> DataFrame:
    """Candidate without removed rows and excluded columns."""
    kept = rows.filter(~is_removed())
    return candidate(kept, changes, known).drop(*changes.excluded_columns)


def display_key(contract: Contract, known: Knowledge) -> Column:
    """Business key, masked where sensitive; the ordinal without a key."""
    keys = contract.business_key
    if not keys or any(k not in known.columns for k in keys):
        return F.col("ordinal").cast("string")
    hidden = {*known.withheld(contract), *contract.named("sensitive")}
    parts = []
    for key in keys:
        cell = F.coalesce(F.col(f"`{key}`"), F.lit(""))
        parts.append(patterns.mask_value(cell) if key in hidden else cell)
    return F.concat_ws("|", *parts)


def ledger(rows: DataFrame, changes: ChangeSet, contract: Contract, known: Knowledge) -> DataFrame:
    """One entry per changed cell and per membership change, produced row by row."""
    hidden = known.withheld(contract)

    def shown(name: str, value: Column) -> Column:
        if name not in hidden:
            return value
        return F.when(value.isNotNull(), patterns.mask_value(value))

    entries = []
    for name in edited_columns(changes):
        before, now = F.col(f"`{name}`"), F.col(f"`{after(name)}`")
        own = [a for a in changes.edits if a.column == name]
        entries.append(
            F.when(
                ~before.eqNullSafe(now),
                F.struct(
                    F.lit(name).alias("column"),
                    shown(name, before).alias("before"),
                    shown(name, now).alias("after"),
                    F.coalesce(owner(own, "action_type"), F.lit("UNAPPROVED")).alias("action_type"),
                    *[owner(own, f).alias(f) for f in ("finding_id", "authorization_source", "authorization_ref")],
                ).cast(LEDGER_ENTRY),
            )
        )
    kinds = {
        "QUARANTINED": changes.by_type("QUARANTINE_RECORDS"),
        "EXCLUDED": changes.by_type("EXCLUDE_EXACT_DUPLICATE_FROM_RELEASE"),
        "FLAGGED": changes.by_type("FLAG_FOR_REVIEW"),
    }
    for status, actions in kinds.items():
        if not actions:
            continue
        entries.append(
            F.when(
                F.col("membership") == status,
                F.struct(
                    F.lit(None).cast("string").alias("column"),
                    F.lit(None).cast("string").alias("before"),
                    F.lit(status).alias("after"),
                    *[
                        first_owner(actions, f).alias(f)
                        for f in ("action_type", "finding_id", "authorization_source", "authorization_ref")
                    ],
                ).cast(LEDGER_ENTRY),
            )
        )
    listed = F.array_compact(F.array(*entries)) if entries else F.array().cast(f"array<{LEDGER_ENTRY}>")
    return rows.select(
        "ordinal", "record_uid", display_key(contract, known).alias("display_key"), F.inline(listed)
    )


def ledger_moves(entries: DataFrame) -> DataFrame:
    """(column, value, weight): what a ledger with unmasked cells takes away from the value counts and adds to them."""
    changed = entries.filter(F.col("column").isNotNull())
    sides = F.array(F.struct(F.col("before").alias("value"), F.lit(-1).alias("weight")), F.struct(F.col("after").alias("value"), F.lit(1).alias("weight")))
    return changed.select("column", F.inline(sides))


def masked_moves(rows: DataFrame, changes: ChangeSet, names: list[str]) -> DataFrame:
    """The same for edited columns whose cells the ledger shows only masked, from the applied rows."""
    each = F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("before"), F.col(f"`{after(name)}`").alias("after")) for name in names
    ])
    return ledger_moves(rows.select(F.inline(each)).filter(~F.col("before").eqNullSafe(F.col("after"))))


def removal_moves(rows: DataFrame, changes: ChangeSet, known: Knowledge) -> DataFrame:
    """The cells of removed records, to be taken away from the candidate's counts."""
    gone = candidate(rows.filter(is_removed()), changes, known).select(*[F.col(f"`{c}`") for c in known.columns])
    return gone.unpivot([], known.columns, "column", "value").withColumn("weight", F.lit(-1))


def ledger_rank() -> Column:
    """Cells first, then quarantined, excluded, flagged."""
    rank = F.when(F.col("column").isNotNull(), 0)
    for position, status in enumerate(MEMBERSHIP_ORDER, start=1):
        rank = rank.when(F.col("after") == status, position)
    return rank


def preview(entries: DataFrame, limit: int = 50) -> DataFrame:
    """First changed cells by (ordinal, column)."""
    return entries.filter(F.col("column").isNotNull()).orderBy("ordinal", "column").limit(limit)


def preview_totals(member_counts: DataFrame, actions: DataFrame) -> DataFrame:
    """Records per action type; a column exclusion counts once."""
    joined = actions.join(member_counts, "finding_id", "left")
    size = F.when(F.col("action_type") == "EXCLUDE_COLUMN_FROM_RELEASE", 1).otherwise(F.coalesce("records", F.lit(0)))
    return joined.groupBy("action_type").agg(F.sum(size).alias("records"))


def cell_diff(source: DataFrame, target: DataFrame, columns: list[str], key: str = "record_uid") -> DataFrame:
    """Null-safe difference of two versions of a table: one join on the unique key, then a projection."""
    pairs = source.select(key, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s")).join(
        target.select(key, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("t")), key
    )
    changed = [
        F.when(
            ~F.col(f"s.`{c}`").eqNullSafe(F.col(f"t.`{c}`")),
            F.struct(F.lit(c).alias("column"), F.col(f"s.`{c}`").alias("before"), F.col(f"t.`{c}`").alias("after")),
        )
        for c in columns
    ]
    return pairs.select(key, F.inline(F.array_compact(F.array(*changed))))


def authorized(changed: DataFrame, authorizations: DataFrame, key: str = "record_uid") -> DataFrame:
    """Changed cells with their authorization; ``UNAPPROVED`` where there is none."""
    return changed.join(authorizations, [key, "column"], "left").withColumn(
        "action_type", F.coalesce("action_type", F.lit("UNAPPROVED"))
    )


def totals(rows: DataFrame, changes: ChangeSet, contract: Contract, known: Knowledge) -> DataFrame:
    """Everything the reconciliation needs from the rows, in one aggregate."""
    done = edited_columns(changes)
    changed = scoped = unapproved = conflicts = F.lit(0)
    for name in done:
        differs = ~F.col(f"`{name}`").eqNullSafe(F.col(f"`{after(name)}`"))
        owned = owner([a for a in changes.edits if a.column == name], "finding_id").isNotNull()
        changed = changed + differs.cast("int")
        scoped = scoped + owned.cast("int")
        unapproved = unapproved + (differs & ~owned).cast("int")
        conflicts = conflicts + (holds(f"SEM-{name}-CONFLICT") & differs).cast("int")
    required = [c for c in contract.named("required") if c in known.columns]

    def filled(name: str, edited_too: bool) -> Column:
        source = after(name) if edited_too and name in done else name
        return (~is_blank(F.col(f"`{source}`"))).cast("int")

    def total(parts: list[Column]) -> Column:
        return F.coalesce(F.sum(sum(parts, F.lit(0))), F.lit(0))

    quarantine, duplicate, flag = (
        any_scope(changes.by_type(kind))
        for kind in ("QUARANTINE_RECORDS", "EXCLUDE_EXACT_DUPLICATE_FROM_RELEASE", "FLAG_FOR_REVIEW")
    )

    def count_if(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return rows.agg(
        F.count("*").alias("records"),
        count_if(F.col("membership") == "QUARANTINED").alias("quarantined"),
        count_if(F.col("membership") == "EXCLUDED").alias("excluded"),
        count_if(F.col("membership") == "FLAGGED").alias("flagged"),
        count_if(~is_removed()).alias("eligible"),
        count_if(quarantine).alias("planned_quarantined"),
        count_if(duplicate & ~quarantine).alias("planned_excluded"),
        count_if(flag & ~quarantine & ~duplicate).alias("planned_flagged"),
        F.coalesce(F.sum(changed), F.lit(0)).alias("changed_cells"),
        F.coalesce(F.sum(scoped), F.lit(0)).alias("scoped_cells"),
        F.coalesce(F.sum(unapproved), F.lit(0)).alias("unapproved_cells"),
        F.coalesce(F.sum(conflicts), F.lit(0)).alias("conflicts_changed"),
        count_if((changed > 0) | is_removed()).alias("affected_records"),
        total([filled(c, False) for c in required]).alias("filled_before"),
        total([filled(c, True) for c in required]).alias("filled_after"),
    )


def reconciliation(rows: DataFrame, stored: DataFrame, changes: ChangeSet, contract: Contract, known: Knowledge) -> DataFrame:
    """What a candidate as it was stored did to the source cells: joins on the record id, one row of sums.

    ``rows`` hold the source cells and the claims, ``stored`` is the candidate read back. Every cell of
    every column is compared, so a change outside the edited columns counts as unapproved. A record
    that is missing in ``stored`` counts as one whose cells became null.

    Digests of the cells that are due and of the stored ones meet first. Where they are equal, the due cells tell
    what was done; only records with other cells, normally none, travel whole. Their ids are written once.
    """
    names, done = known.columns, edited_columns(changes)
    required = [c for c in contract.named("required") if c in names]

    def effects(cell: Callable[[str], Column]) -> dict[str, Column]:
        changed = scoped = unapproved = conflicts = F.lit(0)
        for name in names:
            differs = ~F.col(f"`{name}`").eqNullSafe(cell(name))
            changed = changed + differs.cast("int")
            owned = F.lit(False)
            if name in done:
                owned = owner([a for a in changes.edits if a.column == name], "finding_id").isNotNull()
                scoped = scoped + owned.cast("int")
            unapproved = unapproved + (differs & ~owned).cast("int")
            if name in contract.fields:
                conflicts = conflicts + (holds(f"SEM-{name}-CONFLICT") & differs).cast("int")
        filled = sum([(~is_blank(cell(c))).cast("int") for c in required], F.lit(0))
        return {
            "changed_cells": changed, "scoped_cells": scoped, "unapproved_cells": unapproved, "conflicts_changed": conflicts, "filled_after": filled,
        }

    planned = [after(c) if c in done else c for c in names]
    due = rows.select("record_uid", digest(planned).alias("due"), *[c.alias(n) for n, c in effects(lambda c: F.col(f"`{after(c) if c in done else c}`")).items()])
    kept = stored.select("record_uid", digest(names).alias("kept"))
    sums = list(effects(F.col))
    # A record is odd unless all stored rows of its id hold the due cells.
    told = due.join(kept, "record_uid", "left").groupBy("record_uid").agg(
        F.bool_and(F.coalesce(F.col("due") == F.col("kept"), F.lit(False))).alias("as_due"), *[F.sum(n).alias(n) for n in sums]
    )
    told = written(told.groupBy(F.when(~F.col("as_due"), F.struct("record_uid")).alias("odd")).agg(*[F.sum(n).alias(n) for n in sums]), "reconciled")
    parts = told.filter("odd IS NULL").select(*sums)
    odd = told.filter("odd IS NOT NULL").select(F.col("odd.record_uid").alias("odd_uid"))
    if not odd.isEmpty():
        read = stored.select("record_uid", F.struct(*[F.col(f"`{c}`") for c in names]).alias("stored"))
        whole = rows.join(odd, F.col("record_uid").eqNullSafe(F.col("odd_uid")), "left_semi").join(read, "record_uid", "left")
        parts = parts.unionByName(whole.select(*[c.cast("bigint").alias(n) for n, c in effects(lambda c: F.col(f"stored.`{c}`")).items()]))
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums])


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    return fingerprint(df.select(row_digest(columns).alias("digest")), "digest")


def scope_fingerprint(df: DataFrame) -> DataFrame:
    return fingerprint(df, "record_uid")
