"""All detectors as one narrow pass over the rows.

Every rule of the contract is a Spark expression on the row, so a row's findings are worked out
in place and carried in one ``claims`` column. Only duplicates, key conflicts and repeated
values need a shuffle, and only column-level facts (a handful of values per column) are read
by the driver beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.contract import Contract, FieldRule
from sluice.functions import patterns, predicates
from sluice.functions.text import fold_text, is_blank
from sluice.operators import groups, profile, semantic


CLAIM_SCHEMA = "array<struct<finding_id:string,detail:string>>"
IDENTITY = ("ordinal", "record_uid")

# Evidence the observational date rule needs.
ISO_SHARE = 0.90
OBSERVATIONAL_ALTERNATES = (
    patterns.YMD_SLASH, patterns.DMY_SLASH, patterns.MDY_SLASH, patterns.YMD_COMPACT,
)


@dataclass
class Knowledge:
    """What the driver knows about the columns before the row pass; bounded by the column count."""

    columns: list[str]
    hits: dict[str, int] = field(default_factory=dict)
    empty: dict[str, int] = field(default_factory=dict)
    slash: dict[str, str | None] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    shapes: dict[str, dict[str, int]] = field(default_factory=dict)
    filled: dict[str, int] = field(default_factory=dict)
    candidates: dict[str, list[str]] = field(default_factory=dict)
    truncated: dict[str, bool] = field(default_factory=dict)
    mapping: dict[str, dict[str, str]] = field(default_factory=dict)
    resolver: dict[str, str] = field(default_factory=dict)

    def withheld(self, contract: Contract) -> list[str]:
        declared = set(contract.named("sensitive"))
        return [c for c in self.columns if c in declared or self.hits.get(c, 0) > 0]


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in IDENTITY]


def learn(
    df: DataFrame,
    contract: Contract,
    facts: DataFrame | None = None,
    proposals: DataFrame | None = None,
) -> Knowledge:
    """Column-level facts for the row pass, from the profile if there is one, else from one scan."""
    columns = data_columns(df)
    known = Knowledge(columns=columns)
    if facts is None and contract.observational:
        counts = profile.cell_counts(df, columns)
        facts = profile.column_facts(groups.written(counts, "counts"))
    if facts is not None:
        for row in facts.collect():  # one row per column
            name = row["column"]
            known.hits[name], known.empty[name] = row["sensitive_hits"], row["empty"]
            known.slash[name], known.types[name] = row["slash_label"], row["inferred_type"]
            known.shapes[name], known.filled[name] = dict(row["shapes"]), row["non_empty"]
    else:
        scan_facts(df, contract, known)
    withheld = known.withheld(contract)
    return learn_values(semantic.unlisted_counts(df, contract, withheld), contract, known, proposals)


def learn_values(counts: DataFrame, contract: Contract, known: Knowledge, proposals: DataFrame | None = None) -> Knowledge:
    """Candidate values and their mapping from the counts (column, value, cnt) of unlisted values."""
    # One more than the limit tells whether there would have been more; at most 31 rows per column.
    rows = semantic.candidates(counts, semantic.CANDIDATE_LIMIT + 1).collect()
    for row in sorted(rows, key=lambda r: (r["column"], r["rank"])):
        if row["rank"] > semantic.CANDIDATE_LIMIT:
            known.truncated[row["column"]] = True
        else:
            known.candidates.setdefault(row["column"], []).append(row["value"])
    if known.candidates:
        spark = counts.sparkSession
        listed = [(r["column"], r["value"], r["cnt"], fold_text(r["value"])) for r in rows if r["rank"] <= semantic.CANDIDATE_LIMIT]
        found = spark.createDataFrame(listed, "column string, value string, cnt bigint, norm string")
        mapping = semantic.resolve(found, contract.vocab_table(spark), contract.ambiguity_table(spark), proposals)
        for row in mapping.collect():  # at most 30 per column
            known.mapping.setdefault(row["column"], {})[row["source"]] = row["target"]
            known.resolver[row["column"]] = row["resolver"]
    return known


def scan_facts(df: DataFrame, contract: Contract, known: Knowledge) -> None:
    """Sensitive hits of every column and slash-date evidence where a rule needs it, in one scan."""
    read_scan(scan_row(df, contract, known.columns), contract, known)


def open_dates(contract: Contract, columns: list[str]) -> list[str]:
    return [c for c in columns if c in contract.fields and contract.fields[c].type == "date" and contract.fields[c].format is None]


def scan_row(df: DataFrame, contract: Contract, columns: list[str]) -> DataFrame:
    """One row (hits_<i>, slash_<i>) over the rows of ``df``."""
    aggregates: list[Column] = []
    for index, name in enumerate(columns):
        cell = F.col(f"`{name}`")
        aggregates.append(F.count(F.when(patterns.looks_sensitive(cell) & ~is_blank(cell), 1)).alias(f"hits_{index}"))
    for index, name in enumerate(open_dates(contract, columns)):
        cell = F.col(f"`{name}`")
        undecided = patterns.shape_label(cell) == patterns.SLASH_UNDECIDED
        aggregates.append(
            F.struct(*[a.alias(n) for n, a in profile.slash_evidence(cell, undecided).items()]).alias(f"slash_{index}")
        )
    return df.agg(*aggregates)


def merged_scan(rows: DataFrame) -> DataFrame:
    """The ``scan_row`` of several parts as that of all of them."""

    def merge(name: str) -> Column:
        if name.startswith("hits_"):
            return F.sum(name).alias(name)
        fields = rows.schema[name].dataType.fieldNames()
        return F.struct(*[(F.bool_or if f in ("day_first", "month_first") else F.bool_and)(F.col(name)[f]).alias(f) for f in fields]).alias(name)

    return rows.agg(*[merge(name) for name in rows.columns])


def read_scan(row: DataFrame, contract: Contract, known: Knowledge) -> None:
    dates_ = open_dates(contract, known.columns)
    labels = [profile.slash_label(f"slash_{i}.").alias(f"label_{i}") for i in range(len(dates_))]
    values = row.select("*", *labels).first()
    for index, name in enumerate(dates_):
        known.slash[name] = values[f"label_{index}"]
    for index, name in enumerate(known.columns):
        known.hits[name] = values[f"hits_{index}"]


@dataclass(frozen=True)
class Claim:
    """One way for a row to belong to a finding."""

    finding_id: str
    detail: Column
    holds: Column


def text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def category_claims(name: str, rule: FieldRule, contract: Contract, known: Knowledge) -> list[Claim]:
    """AMB before CAT; conflicting rows leave CAT and SEM."""
    cell = F.col(f"`{name}`")
    out: list[Claim] = []
    tokens = contract.tokens(name)
    ambiguous = predicates.within(cell, tokens) & ~is_blank(cell)
    if tokens:
        out.append(Claim(f"AMB-{name}", cell, ambiguous))
    aliases = {a: t for a, t in rule.aliases.items() if a not in tokens and a.strip()}
    is_alias = predicates.within(cell, list(aliases))
    mapping = known.mapping.get(name, {})
    conflict = F.lit(False)
    other = (rule.consistent_with or {}).get("column")
    if other in known.columns:
        other_cell = F.col(f"`{other}`")
        for target, expected in rule.consistent_with["expected"].items():
            sources = [s for s, t in {**aliases, **mapping}.items() if t == target]
            if sources:
                conflict = conflict | (predicates.within(cell, sources) & ~predicates.within(other_cell, expected))
    if aliases:
        out.append(Claim(f"CAT-{name}", cell, is_alias & ~conflict))
    candidates = known.candidates.get(name, [])
    if mapping:
        out.append(Claim(f"SEM-{name}", cell, predicates.within(cell, list(mapping)) & ~conflict))
    elif candidates and rule.allowed is not None:
        out.append(Claim(f"SEM-{name}", text(None), predicates.within(cell, candidates) & ~conflict))
    if rule.consistent_with is not None and other in known.columns:
        out.append(Claim(f"SEM-{name}-CONFLICT", cell, conflict))
    return out


def covered_values(name: str, rule: FieldRule, contract: Contract, known: Knowledge) -> list[str]:
    """Values another finding already answers for, so they are no vocabulary misses."""
    covered = {*rule.vocabulary, *contract.tokens(name), *known.mapping.get(name, {})}
    if not known.mapping.get(name) and rule.allowed is not None:
        covered.update(known.candidates.get(name, []))
    return sorted(covered)


def validity_claims(name: str, rule: FieldRule, contract: Contract, known: Knowledge) -> list[Claim]:
    cell = F.col(f"`{name}`")
    filled = ~is_blank(cell)
    slash = known.slash.get(name)
    kinds: dict[str, Column] = {}
    if rule.type is not None and rule.type != "string":
        bad = ~predicates.conforms_type(cell, rule, slash)
        if rule.is_date:
            bad = bad & predicates.matched_format(cell, rule, slash).isNull()
        kinds["type"] = bad
    kinds.update(predicates.violations(cell, rule))
    if rule.allowed is not None:
        kinds["allowed"] = ~predicates.within(cell, covered_values(name, rule, contract, known))
    out = [Claim(f"VAL-{name}", text(kind), filled & bad) for kind, bad in kinds.items()]
    if rule.unique and name not in contract.business_key:
        shares = F.coalesce(F.array_contains("repeats", name), F.lit(False))
        out.append(Claim(f"VAL-{name}", text("unique"), shares))
    return out


def contract_claims(contract: Contract, known: Knowledge) -> list[Claim]:
    out: list[Claim] = []
    for name in known.columns:
        rule = contract.fields.get(name)
        if rule is None:
            continue
        cell = F.col(f"`{name}`")
        out += category_claims(name, rule, contract, known)
        if rule.required:
            out.append(Claim(f"MISS-{name}", text(None), is_blank(cell)))
        if rule.is_date and rule.accept_formats:
            fmt = predicates.matched_format(cell, rule, known.slash.get(name))
            out.append(Claim(f"FMT-{name}", fmt, ~is_blank(cell) & fmt.isNotNull()))
        out += validity_claims(name, rule, contract, known)
        if rule.sensitive:
            kind = patterns.sensitive_class(cell)
            out.append(Claim(f"PHI-{name}", kind, ~is_blank(cell) & kind.isNotNull()))
    return out


def observational_alternate(name: str, known: Knowledge) -> str | None:
    """The one second date family of a mostly ISO column, else None."""
    shapes = known.shapes.get(name, {})
    if known.types.get(name) != "date" or shapes.get(patterns.YMD_DASH, 0) < ISO_SHARE * known.filled[name]:
        return None
    seen = [label for label in OBSERVATIONAL_ALTERNATES if shapes.get(label, 0) > 0]
    return seen[0] if len(seen) == 1 else None


def observational_claims(known: Knowledge) -> list[Claim]:
    out: list[Claim] = []
    for name in known.columns:
        cell = F.col(f"`{name}`")
        alternate = observational_alternate(name, known)
        if alternate is not None:
            label = patterns.SLASH_UNDECIDED if alternate in (patterns.DMY_SLASH, patterns.MDY_SLASH) else alternate
            holds = ~is_blank(cell) & (patterns.shape_label(cell) == label)
            out.append(Claim(f"FMT-{name}", text(patterns.LABEL_FORMATS[alternate]), holds))
        if known.hits.get(name, 0) and patterns.is_sensitive_name(name):
            kind = patterns.sensitive_class(cell)
            out.append(Claim(f"PHI-{name}", kind, ~is_blank(cell) & kind.isNotNull()))
    return out


def group_claims() -> list[Claim]:
    return [
        Claim("DUP-EXACT", text(None), F.coalesce("surplus", F.lit(False))),
        Claim("DUP-KEY", text(None), F.coalesce("key_conflict", F.lit(False))),
    ]


def claims_column(found: list[Claim]) -> Column:
    if not found:
        return F.array().cast(CLAIM_SCHEMA)
    entries = [
        F.when(claim.holds, F.struct(F.lit(claim.finding_id).alias("finding_id"), claim.detail.alias("detail")))
        for claim in found
    ]
    return F.array_compact(F.array(*entries))


def group_marks(df: DataFrame, contract: Contract, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Written marks of grouped records, and the distinct-record table; needs no column facts."""
    key = contract.business_key if all(k in columns for k in contract.business_key) else []
    unique = [c for c in contract.named("unique") if c in columns and c not in contract.business_key]
    marked, distinct = groups.marks(df, columns, [] if contract.observational else key, unique)
    return groups.written(marked, "marks"), distinct


def annotate(df: DataFrame, contract: Contract, known: Knowledge, marked: DataFrame) -> DataFrame:
    """Rows with their ``claims``."""
    # The ordinal is unique, so this join cannot be skewed; small mark tables are broadcast by size.
    rows = df.join(marked, "ordinal", "left")
    row_claims = observational_claims(known) if contract.observational else contract_claims(contract, known)
    return rows.select(*df.columns, claims_column(group_claims() + row_claims).alias("claims"))


def row_claimed(df: DataFrame, contract: Contract, known: Knowledge) -> DataFrame:
    """(ordinal, record_uid, claims) of the rows that a rule on the row alone claims; groups are left out."""
    alone = df.withColumn("repeats", F.lit(None).cast("array<string>"))
    claimed = alone.select("ordinal", "record_uid", claims_column(contract_claims(contract, known)).alias("claims"))
    return claimed.filter(F.size("claims") > 0)


def with_groups(claimed: DataFrame, marked: DataFrame) -> DataFrame:
    """The claims of ``row_claimed`` rows and of ``marked`` records together, as ``annotate`` would give them."""
    unique = F.transform(F.coalesce("repeats", F.array().cast("array<string>")), lambda name: F.struct(F.concat(F.lit("VAL-"), name).alias("finding_id"), F.lit("unique").alias("detail")))
    groups_ = claims_column(group_claims()).cast(CLAIM_SCHEMA)
    own = F.coalesce("claims", F.array().cast(CLAIM_SCHEMA))
    return claimed.join(marked, "ordinal", "full").select("ordinal", "record_uid", F.concat(groups_, own, unique.cast(CLAIM_SCHEMA)).alias("claims"))


def members(annotated: DataFrame) -> DataFrame:
    """(finding_id, ordinal, record_uid), one row per affected record."""
    ids = F.array_distinct(F.transform("claims", lambda c: c["finding_id"]))
    return annotated.select(F.explode(ids).alias("finding_id"), "ordinal", "record_uid")


def claim_counts(annotated: DataFrame) -> DataFrame:
    """(finding_id, detail, records): violation kinds, pattern classes, formats, tokens."""
    return (
        annotated.select(F.inline("claims"))
        .groupBy("finding_id", "detail")
        .agg(F.count("*").alias("records"))
    )


# --- Fixed values: finding type, risk, blocking, authorization, action, allowed outcomes --
APPROVE, REJECT, QUARANTINE = "APPROVE_PROPOSAL", "REJECT_PROPOSAL", "QUARANTINE"
EXCLUDE, FLAG = "EXCLUDE", "FLAG_FOR_REVIEW"
POLICY, HUMAN, QUARANTINE_ONLY, FORBIDDEN = (
    "POLICY_AUTHORIZED", "HUMAN_APPROVAL_REQUIRED", "QUARANTINE_ONLY", "FORBIDDEN",
)
FINDING_RULES = {
    "DUP-EXACT": ("EXACT_DUPLICATE", "LOW", False, HUMAN, "EXCLUDE_EXACT_DUPLICATE_FROM_RELEASE", (APPROVE, REJECT)),
    "DUP-KEY": ("BUSINESS_KEY_CONFLICT", "HIGH", True, QUARANTINE_ONLY, "QUARANTINE_RECORDS", (QUARANTINE,)),
    "CAT": ("CATEGORY_VARIANT", "LOW", False, HUMAN, "NORMALIZE_CATEGORY", (APPROVE, REJECT)),
    "FMT": ("FORMAT_INCONSISTENCY", "LOW", False, HUMAN, "STANDARDIZE_DATE_FORMAT", (APPROVE, REJECT)),
    "SEM": ("SEMANTIC_VARIANT", "MEDIUM", True, HUMAN, "NORMALIZE_CATEGORY", (APPROVE, QUARANTINE, REJECT)),
    "SEM-UNMAPPED": ("SEMANTIC_VARIANT", "MEDIUM", True, HUMAN, None, (QUARANTINE, REJECT)),
    "CONFLICT": ("SEMANTIC_CONFLICT", "HIGH", True, QUARANTINE_ONLY, "QUARANTINE_RECORDS", (QUARANTINE,)),
    "AMB": ("KNOWN_AMBIGUOUS_TOKEN", "HIGH", True, QUARANTINE_ONLY, "QUARANTINE_RECORDS", (QUARANTINE,)),
    "MISS": ("REQUIRED_FIELD_MISSING", "HIGH", True, QUARANTINE_ONLY, "QUARANTINE_RECORDS", (QUARANTINE,)),
    "VAL": ("VALIDITY_VIOLATION", "MEDIUM", True, HUMAN, "QUARANTINE_RECORDS", (QUARANTINE, FLAG)),
    "PHI": ("POTENTIAL_DIRECT_IDENTIFIER", "HIGH", True, HUMAN, "EXCLUDE_COLUMN_FROM_RELEASE", (EXCLUDE, QUARANTINE)),
}
AUTO_FLAG_OF = {
    "DUP-EXACT": "exact_duplicate_exclusion",
    "CAT": "category_normalization",
    "FMT": "date_standardization",
}
DETECTOR_ORDER = ("DUP-EXACT", "DUP-KEY", "CAT", "FMT", "SEM", "CONFLICT", "AMB", "MISS", "VAL", "PHI")
# ------------------------------------------------------------------------------------------

CATALOGUE_SCHEMA = (
    "finding_id string, finding_type string, column string, risk_level string, blocking boolean, "
    "authorization_mode string, proposed_action string, allowed_outcomes array<string>, "
    "detector_rank int, column_rank int, zero_cells boolean"
)


def catalogue(contract: Contract, known: Knowledge) -> list[tuple]:
    """Every finding this contract could raise on these columns, with its fixed attributes."""
    possible: list[tuple[str, str, str | None]] = [("DUP-EXACT", "DUP-EXACT", None)]
    if contract.observational:
        for name in known.columns:
            possible += [(f"FMT-{name}", "FMT", name), (f"PHI-{name}", "PHI", name)]
    else:
        key = contract.business_key
        possible.append(("DUP-KEY", "DUP-KEY", key[0] if len(key) == 1 else None))
        for name in known.columns:
            if name in contract.fields:
                sem = "SEM" if known.mapping.get(name) else "SEM-UNMAPPED"
                possible += [
                    (f"CAT-{name}", "CAT", name), (f"FMT-{name}", "FMT", name), (f"SEM-{name}", sem, name),
                    (f"SEM-{name}-CONFLICT", "CONFLICT", name), (f"AMB-{name}", "AMB", name),
                    (f"MISS-{name}", "MISS", name), (f"VAL-{name}", "VAL", name), (f"PHI-{name}", "PHI", name),
                ]
    rows = []
    for finding_id, kind, column in possible:
        finding_type, risk, blocking, mode, action, outcomes = FINDING_RULES[kind]
        if contract.observational:
            blocking, mode, action, outcomes = False, FORBIDDEN, None, ()
        elif kind in AUTO_FLAG_OF and contract.allows(AUTO_FLAG_OF[kind]):
            mode = POLICY
        rank = DETECTOR_ORDER.index("SEM" if kind == "SEM-UNMAPPED" else kind)
        position = known.columns.index(column) if column in known.columns else -1
        rows.append((finding_id, finding_type, column, risk, blocking, mode, action, list(outcomes), rank, position, kind == "DUP-EXACT"))
    return rows


def findings(annotated: DataFrame, contract: Contract, known: Knowledge) -> DataFrame:
    """One row per raised finding; bounded by the number of columns."""
    spark = annotated.sparkSession
    counted = members(annotated).groupBy("finding_id").agg(F.count("*").alias("affected_record_count"))
    fixed = spark.createDataFrame(catalogue(contract, known), CATALOGUE_SCHEMA)
    return counted.join(F.broadcast(fixed), "finding_id").select(
        "finding_id", "finding_type", "column", "affected_record_count",
        F.when(F.col("zero_cells"), F.lit(0)).otherwise(F.col("affected_record_count")).alias("affected_cell_count"),
        "risk_level", "blocking", "authorization_mode", "proposed_action", "allowed_outcomes",
        F.lit("OPEN").alias("disposition"), "detector_rank", "column_rank",
    )


def initial_status(found: DataFrame, contract: Contract) -> DataFrame:
    if contract.observational:
        status = F.lit("NOT_EVALUATED")
    else:
        status = F.when(F.coalesce(F.bool_or("blocking"), F.lit(False)), "BLOCKED").otherwise("CONDITIONAL_PASS")
    return found.agg(status.alias("release_status"), F.count("*").alias("findings"))


def warnings(contract: Contract, known: Knowledge) -> list[tuple[str, str | None]]:
    """(code, column) of everything skipped or withheld; driver-side, one per column at most."""
    out: list[tuple[str, str | None]] = []
    if contract.observational:
        out.append(("NO_CONTRACT", None))
        out += [("SENSITIVE_NAME_UNLIKELY", c) for c in known.columns if known.hits.get(c) and not patterns.is_sensitive_name(c)]
        return out
    out += [("KEY_COLUMN_MISSING", k) for k in contract.business_key if k not in known.columns]
    out += [("FIELD_MISSING", f) for f in contract.fields if f not in known.columns]
    withheld = known.withheld(contract)
    for name in known.columns:
        rule = contract.fields.get(name, FieldRule())
        if rule.consistent_with and rule.consistent_with["column"] not in known.columns:
            out.append(("CONSISTENCY_COLUMN_MISSING", name))
        if rule.semantic and name in withheld:
            out.append(("SEMANTIC_WITHHELD", name))
        if known.truncated.get(name):
            out.append(("CANDIDATES_TRUNCATED", name))
        if known.candidates.get(name) and not known.mapping.get(name) and rule.allowed is None:
            out.append(("OPEN_VOCABULARY_UNMAPPED", name))
        if rule.sensitive and not known.hits.get(name):
            out.append(("SENSITIVE_WITHOUT_HIT", name))
        if not rule.sensitive and known.hits.get(name):
            out.append(("UNDECLARED_SENSITIVE", name))
    return out





EXAMPLE_LIMIT = 10
SAMPLE_LIMIT = 20


def samples(found: DataFrame, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """First records per finding; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("finding_id").orderBy("ordinal")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def violation_summary(annotated: DataFrame, contract: Contract, known: Knowledge) -> DataFrame:
    """(finding_id, kind, records, distinct_values, examples) of value violations.

    The first ten values are taken and the sensitive-looking ones among them dropped; a withheld
    column shows none.
    """
    withheld = known.withheld(contract)
    columns = [c for c in known.columns if c in contract.fields]
    cell = F.create_map(*[x for c in columns for x in (F.lit(f"VAL-{c}"), F.col(f"`{c}`"))])
    bad = (
        annotated.select(cell.alias("cells"), F.inline("claims"))
        .filter(F.col("finding_id").startswith("VAL-") & (F.col("detail") != "unique"))
        .select("finding_id", F.col("detail").alias("kind"), F.try_element_at("cells", F.col("finding_id")).alias("value"))
        .groupBy("finding_id", "kind", "value")
        .agg(F.count("*").alias("cnt"))
    )
    order = Window.partitionBy("finding_id", "kind").orderBy(F.desc("cnt"), F.asc("value"))
    hidden = F.col("finding_id").isin(*[f"VAL-{c}" for c in withheld]) if withheld else F.lit(False)
    shown = (
        bad.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= EXAMPLE_LIMIT)
        .filter(~hidden & ~patterns.looks_sensitive(F.col("value")))
        .groupBy("finding_id", "kind")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("top"))
        .select("finding_id", "kind", F.transform("top", lambda t: t["value"]).alias("examples"))
    )
    sums = bad.groupBy("finding_id", "kind").agg(F.sum("cnt").alias("records"), F.count("*").alias("distinct_values"))
    return sums.join(shown, ["finding_id", "kind"], "left")


def masked_rows(source: DataFrame, wanted: DataFrame, contract: Contract, known: Knowledge) -> DataFrame:
    """A few member rows per finding with withheld columns masked."""
    hidden = known.withheld(contract)
    shown = [
        patterns.mask_value(F.col(f"`{c}`")).alias(c) if c in hidden else F.col(f"`{c}`") for c in known.columns
    ]
    few = wanted.select("finding_id", "record_uid")  # at most SAMPLE_LIMIT per finding
    return source.join(F.broadcast(few), "record_uid").select("finding_id", "ordinal", "record_uid", *shown)


def presentation_order(found: DataFrame) -> DataFrame:
    """Blocking first, then risk, then id. One run has a few findings per column at most."""
    risk = F.array_position(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), F.col("risk_level"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("blocking"), risk, "finding_id")
    return found.withColumn("position", F.row_number().over(order))
