"""Proposals checked against what was really observed, as joins over proposal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import patterns
from sluice.functions.dates import label_to_format
from sluice.functions.text import normalize_text, sanitize
from sluice.operators.groups import join_back

# Reason codes in the order in which they are reported, evidence facts, type table.
MAPPING_REASONS = (
    "UNKNOWN_FINDING", "UNKNOWN_COLUMN", "STALE_OR_UNKNOWN_INPUT", "HALLUCINATED_SOURCE_VALUE",
    "UNKNOWN_CANONICAL_TARGET", "UNKNOWN_EVIDENCE_REFERENCE", "AMBIGUITY_REGISTRY_HIT",
    "UNSUPPORTED_ACTION", "ABSTENTION_WITH_MAPPING",
)
PROFILE_FACTS = ("type", "null_rate", "distinct", "top_values", "format", "range", "sensitive_hits")
COMPATIBLE_TYPES = {
    "integer": ("integer", "number", "string"),
    "number": ("number", "string"),
    "date": ("date", "string"),
    "datetime": ("datetime", "string"),
    "boolean": ("boolean", "string"),
    "string": ("string",),
    "empty": ("string",),
}
ID_NAME_RX = r"(?i)(^|_)id$|^id($|_)|_id_|_uid$|_key$"
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９．，％", "0123456789.,%"
VERSION_RX = r"(?U)\d+(?:\.\d+){2,}"
NUMBER_RX = r"(?U)\d[\d,]*(?:\.\d+)?"
MAX_ALLOWED_DRAFT = 12


def proposal_is_approvable() -> Column:
    """Grounded, not abstaining, and with a mapping to offer."""
    return F.col("grounded") & ~F.col("abstained") & (F.size("mapping") > 0)


# -- mapping proposals -----------------------------------------------------------------------
def ground_mappings(
    proposals: DataFrame, requests: DataFrame, candidates: DataFrame, vocabulary: DataFrame,
    ambiguity: DataFrame, evidence: DataFrame,
) -> DataFrame:
    """(proposal_id, valid, reasons, affected_records).

    ``proposals``: proposal_id, request_id, finding_id, column, input_hash, action, abstained,
    mapping map<string,string>, evidence_refs array<string>. ``requests``: request_id, finding_id,
    column, input_hash. The lookups have one row per (request_id, value); candidates carry ``cnt``.
    """
    asked = requests.select(
        "request_id", F.col("finding_id").alias("r_finding"), F.col("column").alias("r_column"), F.col("input_hash").alias("r_hash")
    )
    yes = F.lit(True)
    head = join_back(proposals, asked, "request_id", "proposal_id", "left")
    # One request may receive a third of all proposals, so every lookup is a salted or checked join.
    pairs = proposals.select("proposal_id", "request_id", F.explode("mapping").alias("source", "target"))
    lookups = (
        (candidates.select("request_id", F.col("value").alias("source"), "cnt"), "source"),
        (vocabulary.select("request_id", F.col("value").alias("target"), yes.alias("listed")), "target"),
        (ambiguity.select("request_id", F.col("value").alias("source"), yes.alias("ambiguous")), "source"),
    )
    for table, column in lookups:
        pairs = join_back(pairs, table, ["request_id", column], "proposal_id", "left")
    pairs = pairs.groupBy("proposal_id").agg(
        F.bool_or(F.col("cnt").isNull()).alias("unseen"),
        F.bool_or(F.col("listed").isNull()).alias("unlisted"),
        F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"),
        F.sum("cnt").alias("cells"),
    )
    cited = proposals.select("proposal_id", "request_id", F.explode("evidence_refs").alias("value"))
    supplied = evidence.select("request_id", "value", yes.alias("supplied"))
    refs = (
        join_back(cited, supplied, ["request_id", "value"], "proposal_id", "left")
        .filter("supplied IS NULL").select("proposal_id").distinct().withColumn("bad_ref", yes)
    )
    joined = head.join(pairs, "proposal_id", "left").join(refs, "proposal_id", "left")

    def differs(mine: str, theirs: str) -> Column:
        return ~F.col(mine).eqNullSafe(F.col(theirs))

    tests = {
        "UNKNOWN_FINDING": differs("finding_id", "r_finding"),
        "UNKNOWN_COLUMN": differs("column", "r_column"),
        "STALE_OR_UNKNOWN_INPUT": differs("input_hash", "r_hash"),
        "HALLUCINATED_SOURCE_VALUE": F.col("unseen"),
        "UNKNOWN_CANONICAL_TARGET": F.col("unlisted"),
        "UNKNOWN_EVIDENCE_REFERENCE": F.col("bad_ref"),
        "AMBIGUITY_REGISTRY_HIT": F.col("ambiguous"),
        "UNSUPPORTED_ACTION": F.col("action") != "NORMALIZE_CATEGORY",
        "ABSTENTION_WITH_MAPPING": F.col("abstained") & (F.size("mapping") > 0),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(tests[code], F.lit(False)), code) for code in MAPPING_REASONS]))
    checked = joined.select("proposal_id", "abstained", "cells", reasons.alias("reasons"))
    valid = F.size("reasons") == 0
    return checked.select(
        "proposal_id", valid.alias("valid"), "reasons",
        F.when(valid & ~F.col("abstained"), F.coalesce("cells", F.lit(0))).otherwise(0).alias("affected_records"),
    )


def replayed(stored: DataFrame, fresh: DataFrame, target_finding: str) -> DataFrame:
    """Mappings after a re-run of one finding: its fresh mapping, everything else as stored."""
    keep = stored.filter(F.col("finding_id") != target_finding)
    return keep.unionByName(fresh.filter(F.col("finding_id") == target_finding))


# -- what was visible ------------------------------------------------------------------------
def heuristic_sensitive(profile: DataFrame) -> DataFrame:
    """Columns treated as sensitive: withheld, declared, hit, or named like personal data."""
    tokens = [F.lower("column").contains(t) for t in patterns.SENSITIVE_NAME_TOKENS]
    named = tokens[0]
    for token in tokens[1:]:
        named = named | token
    declared = F.coalesce(F.array_contains(F.split("contract_flags", ","), "sensitive"), F.lit(False))
    return profile.filter(F.col("withheld") | declared | (F.col("sensitive_hit_count") > 0) | named).select("column")


def redacted_profile(profile: DataFrame) -> DataFrame:
    """The profile without any value of a sensitive column; counts and classes stay."""
    marked = profile.join(F.broadcast(heuristic_sensitive(profile)).withColumn("hidden", F.lit(True)), "column", "left")
    hidden = F.coalesce("hidden", F.lit(False))
    shown = F.filter(
        F.transform("top_values", lambda t: F.struct(sanitize(t["value"]).alias("value"), t["count"].alias("count"))),
        lambda t: t["value"] != "",
    )
    return marked.select(
        "column", "inferred_type", "null_count", "null_rate", "distinct_count", "max_length",
        F.when(~hidden, sanitize(F.col("min_value"))).alias("min_value"),
        F.when(~hidden, sanitize(F.col("max_value"))).alias("max_value"),
        F.when(hidden, F.array().cast("array<struct<value:string,count:bigint>>")).otherwise(shown).alias("top_values"),
        "format_patterns", "sensitive_hit_count", hidden.alias("values_withheld"),
    )


def observed_values(profile: DataFrame) -> DataFrame:
    """(column, value) pairs that were visible; none for sensitive columns."""
    return redacted_profile(profile).select("column", F.explode("top_values").alias("t")).select("column", "t.value").distinct()


def redacted_candidates(counts: DataFrame, limit: int = 30) -> DataFrame:
    """Candidates that survive clean-up unchanged, at most ``limit`` per column."""
    order = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("value"))
    clean = counts.filter((F.col("value") != "") & (sanitize(F.col("value")) == F.col("value")))
    return clean.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def observed_formats(facts: DataFrame) -> DataFrame:
    """(column, format, cells, rank): date formats seen in a column, most frequent first."""
    known = {label: label_to_format(label) for label in (*patterns.LABEL_FORMATS, patterns.ISO_DATETIME)}
    pairs = [x for label, fmt in known.items() if fmt for x in (F.lit(label), F.lit(fmt))]
    order = Window.partitionBy("column").orderBy(F.desc("cells"), F.asc("pattern"))
    return (
        facts.select("column", F.explode("shapes").alias("pattern", "cells"))
        .withColumn("format", F.try_element_at(F.create_map(*pairs), F.col("pattern")))
        .filter("format IS NOT NULL")
        .withColumn("rank", F.row_number().over(order))
        .select("column", "format", "cells", "rank")
    )


# -- drafted rules ---------------------------------------------------------------------------
def ground_rules(draft: DataFrame, profile: DataFrame, observed: DataFrame, formats: DataFrame) -> DataFrame:
    """(field, rule, item, reason): null reason means accepted.

    ``draft`` is long: (field, rule, item, value) with rule in required, unique, sensitive, type,
    format, allowed, canonical, evidence. Allowed values and canonical terms have one row each
    (``item`` is the canonical target); a group is rejected as soon as one of its values is unseen.
    """
    sensitive = heuristic_sensitive(profile).withColumn("is_sensitive", F.lit(True))
    types = [x for kind, ok in COMPATIBLE_TYPES.items() for x in (F.lit(kind), F.array(*[F.lit(o) for o in ok]))]
    columns = profile.select(F.col("column").alias("field"), "inferred_type").join(
        sensitive.withColumnRenamed("column", "field"), "field", "left"
    )
    compatible = F.array_contains(F.try_element_at(F.create_map(*types), F.col("inferred_type")), F.col("value"))
    typed = (
        draft.filter("rule = 'type'").join(columns, "field").filter(compatible)
        .select("field", F.col("value").alias("accepted_type"))
    )
    seen = observed.select(F.col("column").alias("field"), "value", F.lit(True).alias("seen"))
    printed = formats.select(F.col("column").alias("field"), F.col("format").alias("value"), F.lit(True).alias("printed"))
    rows = (
        draft.join(columns, "field", "left")
        .join(typed, "field", "left")
        .join(seen, ["field", "value"], "left")
        .join(printed, ["field", "value"], "left")
    )
    supplied = F.array(*[F.concat(F.lit("PROFILE:"), F.col("field"), F.lit(f":{fact}")) for fact in PROFILE_FACTS])
    rule, unseen = F.col("rule"), F.col("seen").isNull()
    dated = F.coalesce(F.col("accepted_type").isin("date", "datetime"), F.lit(False))
    reason = (
        F.when(F.col("inferred_type").isNull(), "UNKNOWN_COLUMN")
        .when((rule == "evidence") & ~F.array_contains(supplied, F.col("value")), "UNKNOWN_EVIDENCE")
        .when((rule == "sensitive") & (F.col("value") == "false") & F.coalesce("is_sensitive", F.lit(False)), "SENSITIVE_DOWNGRADE")
        .when((rule == "type") & ~compatible, "TYPE_MISMATCH")
        .when((rule == "format") & F.col("printed").isNull(), "UNKNOWN_FORMAT")
        .when((rule == "format") & ~dated, "TYPE_MISMATCH")
        .when(rule.isin("allowed", "canonical") & unseen, "UNOBSERVED_VALUE")
    )
    return (
        rows.select("field", F.when(F.col("inferred_type").isNull(), "field").otherwise(rule).alias("rule"),
                    F.when(F.col("inferred_type").isNotNull(), F.col("item")).alias("item"), reason.alias("reason"))
        .groupBy("field", "rule", "item")
        .agg(F.max("reason").alias("reason"))
    )


def derived_formats(draft: DataFrame, profile: DataFrame, observed: DataFrame, formats: DataFrame) -> DataFrame:
    """(field, format, accept_formats): accepted formats with the column's other observed formats, most frequent first."""
    grounded = ground_rules(draft, profile, observed, formats).filter("rule = 'format' AND reason IS NULL").select("field")
    chosen = draft.filter("rule = 'format'").select("field", F.col("value").alias("chosen")).join(grounded, "field")
    # A column has one row per known format at most.
    others = formats.groupBy(F.col("column").alias("field")).agg(F.array_sort(F.collect_list(F.struct("rank", "format"))).alias("found"))
    rest = F.filter(F.transform("found", lambda f: f["format"]), lambda f: f != F.col("chosen"))
    return chosen.join(others, "field", "left").select("field", F.col("chosen").alias("format"), F.coalesce(rest, F.array().cast("array<string>")).alias("accept_formats"))


def ground_aliases(entries: DataFrame, observed: DataFrame) -> DataFrame:
    """(field, position, target, aliases, status) of drafted spellings (field, position, target, aliases).

    Every value of an entry has to be observed (else REJECTED). Within a field a term is either a target or an alias of
    one target: the earlier entry has it, a later one loses the alias, and an entry that loses its target or all of
    its aliases is SKIPPED. A field's entries are folded in their order; a draft has a bounded number of them.
    """
    terms = entries.select("field", "position", F.explode(F.concat(F.array("target"), "aliases")).alias("value"))
    known = observed.select(F.col("column").alias("field"), "value").distinct().withColumn("seen", F.lit(True))
    grounded = terms.join(known, ["field", "value"], "left").groupBy("field", "position").agg(F.bool_and(F.coalesce("seen", F.lit(False))).alias("grounded"))
    entry = F.struct("position", "target", F.array_distinct("aliases").alias("aliases"), "grounded")
    per_field = entries.join(grounded, ["field", "position"]).groupBy("field").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    done = "array<struct<position: int, target: string, aliases: array<string>, status: string>>"
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("targets"), none.alias("taken"), F.array().cast(done).alias("done"))

    def step(state: Column, e: Column) -> Column:
        free = F.filter(e["aliases"], lambda a: (a != e["target"]) & ~F.array_contains(state["taken"], a) & ~F.array_contains(state["targets"], a))
        kept = e["grounded"] & (F.size(free) > 0) & ~F.array_contains(state["taken"], e["target"])
        status = F.when(~e["grounded"], "REJECTED").when(kept, "ACCEPTED").otherwise("SKIPPED")
        row = F.struct(e["position"].cast("int").alias("position"), e["target"].alias("target"), F.when(kept, free).otherwise(none).alias("aliases"), status.alias("status"))
        return F.struct(
            F.when(kept, F.array_append(state["targets"], e["target"])).otherwise(state["targets"]).alias("targets"),
            F.when(kept, F.concat(state["taken"], free)).otherwise(state["taken"]).alias("taken"),
            F.concat(state["done"], F.array(row).cast(done)).alias("done"),
        )

    return per_field.select("field", F.inline(F.aggregate("entries", start, step, lambda state: state["done"])))


def ground_table_rules(draft: DataFrame, columns: DataFrame, observed: DataFrame) -> DataFrame:
    """Business key and ambiguity entries: (rule, column, value, reason). Input (rule, column, value)."""
    known = columns.select("column", F.lit(True).alias("known"))
    seen = observed.select("column", "value", F.lit(True).alias("seen"))
    return draft.join(known, "column", "left").join(seen, ["column", "value"], "left").select(
        "rule", "column", "value",
        F.when(F.col("known").isNull(), "UNKNOWN_COLUMN")
        .when((F.col("rule") == "ambiguity") & F.col("seen").isNull(), "UNOBSERVED_VALUE").alias("reason"),
    )


def draft_fields(profile: DataFrame, formats: DataFrame) -> DataFrame:
    """Heuristic rules per column from its profile."""
    sensitive = heuristic_sensitive(profile).withColumn("is_sensitive", F.lit(True))
    dominant = formats.filter("rank = 1").select("column", "format")
    rows = F.col("null_count") + F.col("non_empty")
    kind = F.col("inferred_type")
    base = (
        profile.withColumn("non_empty", F.aggregate("format_patterns", F.lit(0).cast("bigint"), lambda a, e: a + e["value"]))
        .join(sensitive, "column", "left").join(dominant, "column", "left")
        .withColumn("is_sensitive", F.coalesce("is_sensitive", F.lit(False)))
    )
    listed = (~F.col("is_sensitive")) & (kind == "string") & F.col("distinct_count").between(2, MAX_ALLOWED_DRAFT) & (
        F.size("top_values") == F.col("distinct_count")
    )
    return base.select(
        "column",
        ((F.col("null_count") == 0) & (kind != "empty") & (rows > 0)).alias("required"),
        ((rows > 1) & (F.col("distinct_count") == F.col("non_empty")) & (F.col("distinct_count") > 1)).alias("unique"),
        F.when(~kind.isin("string", "empty"), kind).alias("type"),
        F.when(kind.isin("date", "datetime"), F.col("format")).alias("format"),
        F.col("is_sensitive").alias("sensitive"),
        F.when(listed, F.transform("top_values", lambda t: t["value"])).otherwise(F.array().cast("array<string>")).alias("allowed"),
    )


def draft_canonical(profile: DataFrame) -> DataFrame:
    """(column, target, alias): spellings of one normalized value; the most frequent is the target."""
    sensitive = heuristic_sensitive(profile)
    best = Window.partitionBy("column", "norm").orderBy(F.desc("count"), F.asc("value"))
    spelled = (
        profile.filter("inferred_type = 'string'").join(sensitive, "column", "left_anti")
        .select("column", F.explode("top_values").alias("t")).select("column", "t.value", "t.count")
        .withColumn("norm", normalize_text("value"))
        .withColumn("rank", F.row_number().over(best))
    )
    target = spelled.filter("rank = 1").select("column", "norm", F.col("value").alias("target"))
    return spelled.filter("rank > 1").join(target, ["column", "norm"]).select("column", "target", F.col("value").alias("alias"))


def draft_business_key(fields: DataFrame, order: list[str]) -> DataFrame:
    """First unique column that is named like an id, else the first unique column."""
    position = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column"))
    named = F.col("column").rlike(ID_NAME_RX)
    return fields.filter("unique").select("column", named.alias("named"), position.alias("position")).orderBy(
        F.desc("named"), F.asc("position")
    ).limit(1).select("column")


# -- narrative claims ------------------------------------------------------------------------
def number_tokens(text: Column) -> Column:
    """Numbers in a text: full-width digits folded, version strings dropped, trailing marks cut."""
    folded = F.translate(text, FULL_WIDTH, HALF_WIDTH)
    scrubbed = F.regexp_replace(folded, VERSION_RX, " ")
    found = F.regexp_extract_all(scrubbed, F.lit(NUMBER_RX), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(t, r"[,.]+$", ""))


def unverified_numbers(claims: DataFrame, facts: list[tuple[str, object]]) -> DataFrame:
    """(claim_id, token) for every number of a claim that equals no fact.

    ``facts`` is the named fact list of one release, some twenty entries.
    """
    numbers = [str(v) for _, v in facts if isinstance(v, (int, float)) and not isinstance(v, bool)]
    strings = [v for _, v in facts if isinstance(v, str)] + [name for name, _ in facts]
    token = F.col("token")
    plain = F.regexp_replace(token, ",", "")
    number = plain.try_cast("decimal(38,10)")
    equal = F.coalesce(number.isin(*[F.lit(n).cast("decimal(38,10)") for n in numbers]), F.lit(False)) if numbers else F.lit(False)
    quoted = F.exists(F.array(*[F.lit(s) for s in strings]), lambda s: s.contains(plain)) if strings else F.lit(False)
    return (
        claims.select("claim_id", F.explode(F.array_distinct(number_tokens(F.col("text")))).alias("token"))
        .filter((token != "") & ~equal & ~quoted)
    )


def unknown_facts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, fact_id) references to facts that do not exist."""
    return claims.select("claim_id", F.explode("fact_ids").alias("fact_id")).distinct().join(facts.select("fact_id"), "fact_id", "left_anti")


def verify_claims(claims: DataFrame, facts: list[tuple[str, object]]) -> DataFrame:
    """(claim_id, verified, reason) per claim."""
    spark = claims.sparkSession
    known = spark.createDataFrame([(name,) for name, _ in facts], "fact_id string")
    bad_facts = unknown_facts(claims, known).groupBy("claim_id").agg(F.array_join(F.sort_array(F.collect_set("fact_id")), ",").alias("facts"))
    bad_numbers = unverified_numbers(claims, facts).groupBy("claim_id").agg(F.array_join(F.sort_array(F.collect_set("token")), ",").alias("numbers"))
    joined = claims.select("claim_id").join(bad_facts, "claim_id", "left").join(bad_numbers, "claim_id", "left")
    reason = F.concat_ws("; ", F.concat(F.lit("UNKNOWN_FACT:"), "facts"), F.concat(F.lit("UNVERIFIED_NUMBER:"), "numbers"))
    return joined.select("claim_id", (reason == "").alias("verified"), F.nullif(reason, F.lit("")).alias("reason"))
