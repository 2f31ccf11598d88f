"""Tables that span many runs: events, calls, decisions and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.groups import join_back

MAX_CALLS_PER_RUN = 8  # fixed value


def sequenced(
    events: DataFrame, run: str, ts: str, tie: str, last: DataFrame | None = None, bucket: str = "minute"
) -> DataFrame:
    """Number the events of each run by time, after the stored maximum in ``last`` (run, last_seq).

    A run may hold a third of all events, so rows are ranked within (run, minute) only; running
    totals over the minutes of a run, one small row each, give the offsets.
    """
    placed = events.withColumn("bucket", F.date_trunc(bucket, F.col(ts)))
    sizes = placed.groupBy(run, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(run).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(run, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if last is not None:
        offsets = offsets.join(last, run, "left").withColumn("offset", F.col("offset") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")
    within = Window.partitionBy(run, "bucket").orderBy(ts, tie)
    ranked = placed.withColumn("position", F.row_number().over(within))
    return ranked.join(offsets, [run, "bucket"]).withColumn("seq", F.col("offset") + F.col("position")).drop("bucket", "offset", "position")


def replay(log: DataFrame, after: int) -> DataFrame:
    return log.filter(F.col("seq") > after)


def daily_admitted(calls: DataFrame, ts: str, tie: str, cap: int) -> DataFrame:
    """The first ``cap`` calls of every UTC day; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("day").orderBy(ts, tie)
    return calls.withColumn("day", F.to_date(ts)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def daily_budget(calls: DataFrame, ts: str, cap: int) -> DataFrame:
    """(day, calls_used, refused, exhausted)."""
    n = F.count("*")
    return calls.groupBy(F.to_date(ts).alias("day")).agg(
        F.least(n, F.lit(cap)).alias("calls_used"), F.greatest(n - cap, F.lit(0)).alias("refused"), (n >= cap).alias("exhausted")
    )


def call_usage(calls: DataFrame, run: str, live: Column, cap: int = MAX_CALLS_PER_RUN) -> DataFrame:
    """(run, calls, live_calls, over_cap)."""
    return calls.groupBy(run).agg(F.count("*").alias("calls"), F.count(F.when(live, 1)).alias("live_calls")).withColumn(
        "over_cap", F.col("live_calls") > cap
    )


def idempotent(requests: DataFrame, run: str, key: str, ts: str, tie: str) -> DataFrame:
    """Outcome of every apply request: the first key of a run wins, repeats replay it, others are refused."""
    order = F.struct(ts, tie)
    first = requests.groupBy(run).agg(
        F.min_by(key, order).alias("winning_key"), F.min_by(tie, order).alias("winner")
    )
    joined = join_back(requests, first, run, tie)
    outcome = (
        F.when(F.col(tie) == F.col("winner"), "APPLIED").when(F.col(key) == F.col("winning_key"), "REPLAYED").otherwise("REFUSED")
    )
    return joined.select(*requests.columns, outcome.alias("outcome"))


def expired(runs: DataFrame, active: DataFrame, now: Column, hours: int, protected: Column) -> DataFrame:
    """Runs old enough to delete that are neither protected nor active."""
    cutoff = now - F.expr(f"INTERVAL {hours} HOURS")
    return runs.filter((F.col("created_at") <= cutoff) & ~protected).join(active, "run_id", "left_anti")


def first_owner(action_members: DataFrame) -> DataFrame:
    """The first action that claims a membership owns it: (status, record_uid, finding_id)."""
    return action_members.groupBy("status", "record_uid").agg(F.min("action_rank").alias("action_rank"))


def last_owner(action_cells: DataFrame) -> DataFrame:
    """The last action that edits a cell owns it: (column, record_uid, action_rank)."""
    return action_cells.groupBy("column", "record_uid").agg(F.max("action_rank").alias("action_rank"))


def finding_totals(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Findings per risk, per mode and per blocking flag, in one pass over grouping sets."""
    keys = by or []
    columns = ["risk_level", "authorization_mode", "blocking"]
    sets = [[*keys, c] for c in columns]
    return found.groupingSets(
        [tuple(F.col(c) for c in s) for s in sets], *[F.col(c) for c in [*keys, *columns]]
    ).agg(F.count("*").alias("findings"))


def chain_audit(runs: DataFrame, keys: list[str], hashes: list[str]) -> DataFrame:
    """Conservation over run tables: every hash of a run must have one single value."""
    return runs.groupBy(*keys).agg(*[(F.count_distinct(h) == 1).alias(h) for h in hashes])


def semantic_summary(proposals: DataFrame, run: str) -> DataFrame:
    """Per run: proposals offered, abstained and rejected by grounding."""
    ok, abstained = F.col("grounded"), F.col("abstained")
    return proposals.groupBy(run).agg(
        F.count(F.when(~abstained & ok, 1)).alias("proposals"),
        F.count(F.when(abstained, 1)).alias("abstained"),
        F.count(F.when(~abstained & ~ok, 1)).alias("rejected"),
    )


def proposals_against_calls(proposals: DataFrame, calls: DataFrame) -> DataFrame:
    """Does the call of a proposal exist, with the same finding and the same input hash?"""
    seen = calls.select("call_id", F.col("finding_id").alias("c_finding"), F.col("input_hash").alias("c_hash")).distinct()
    matched = join_back(proposals, seen, "call_id", "proposal_id", "left")
    # A call id that was used more than once must not multiply a proposal: any of its calls may answer.
    return matched.groupBy("proposal_id").agg(
        F.bool_or(F.col("c_finding").isNotNull()).alias("call_exists"),
        F.bool_or(F.coalesce(F.col("finding_id") == F.col("c_finding"), F.lit(False))).alias("same_finding"),
        F.bool_or(F.coalesce(F.col("input_hash") == F.col("c_hash"), F.lit(False))).alias("same_input"),
    )


def named_facts(values: DataFrame) -> DataFrame:
    """One row of release facts to (fact_id, value)."""
    return values.select(*[F.col(c).cast("string").alias(c) for c in values.columns]).unpivot([], values.columns, "fact_id", "value")


def search(runs: DataFrame, lifecycle: str | None, needle: str) -> DataFrame:
    """Runs in a lifecycle whose id or name contains the needle, newest first."""
    hit = F.lower("run_id").contains(needle.lower()) | F.lower("name").contains(needle.lower())
    chosen = runs.filter(hit) if lifecycle is None else runs.filter(hit & (F.col("lifecycle") == lifecycle))
    return chosen.orderBy(F.desc("created_at"))
