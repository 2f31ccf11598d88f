"""URL filter by empirical-Bayes host reputation.

Outcomes of labelled pages are counted per host. From the whole table down, each level's bad rate is
shrunk towards the level above: suffix, registered domain (the last two labels of a host), host. The
prior of a level is a beta distribution around its parent's estimate whose weight is fitted by the
moments of the level's own counts, so a level that varies much is shrunk little. A host is blocked
when the lower ``BOUND`` quantile of its beta posterior exceeds ``MAX_BAD`` times the overall rate
(0.9 at most); a host without labelled pages has its domain's prior as posterior. Fixed rules on
(host, path) come before the estimate.

Only counts per host are ever joined, never pages with pages. Defined results: a null url or one
without ``://`` has empty host and path and is judged like any host; labels without a page, or with
contradicting values for one document, count for nothing; repeated pages count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import LOWER, UPPER
from sluice.session import written

# Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BOUND = 0.05
MAX_BAD = 1.5
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, outcome in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return name, verdict


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (even and odd terms by turns)."""
    from math import lgamma

    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log_beta = np.array([lgamma(s) + lgamma(t) - lgamma(s + t) for s, t in zip(p, q)])
    front = np.exp(p * np.log(np.maximum(z, 1e-300)) + q * np.log(np.maximum(1 - z, 1e-300)) - log_beta) / p
    fraction = np.ones_like(z)
    for m in range(300, 0, -1):  # from the innermost term outwards
        k = m // 2
        if m % 2:
            term = -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))
        else:
            term = k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k))
        fraction = 1 + term / np.where(np.abs(fraction) < 1e-300, 1e-300, fraction)
    area = front / fraction
    return np.where(flip, 1 - area, area)


def beta_quantile(share: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        mid = (low + high) / 2
        below = beta_below(mid, a, b) < share
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def posterior_bound(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Lower quantile of beta(bad + weight * prior, good + weight * (1 - prior)) given as (a, b, share)."""
    for a, b, share in batches:
        yield pd.Series(beta_quantile(float(share.iloc[0]) if len(share) else 0.5, a.to_numpy(float), b.to_numpy(float)))


def with_parents(counts: DataFrame) -> DataFrame:
    """Hosts with their registered domain and suffix; a host of one label is its own."""
    return counts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def reputation(counts: DataFrame, bound: float = BOUND) -> DataFrame:
    """(host, n, bad, estimate, lower, base) from counts per host (host, n, bad: long)."""
    table = written(with_parents(counts.select("host", "n", "bad")), "hosts")
    total = table.agg(F.sum("n"), F.sum("bad")).first()
    base = ((total[1] or 0) + 0.5) / ((total[0] or 0) + 1.0)
    estimates = table.withColumn("parent", F.lit(base))
    for level in LEVELS:
        keys = list(LEVELS[: LEVELS.index(level) + 1])
        level_counts = estimates.groupBy(*keys).agg(F.sum("n").alias("level_n"), F.sum("bad").alias("level_bad"), F.first("parent").alias("prior"))
        # Moments: sum of n (rate - prior)^2 against what binomial noise alone would give.
        rate = F.col("level_bad") / F.col("level_n")
        spread, noise, rows, size, squares = level_counts.where("level_n > 0").agg(
            F.sum(F.col("level_n") * (rate - F.col("prior")) ** 2), F.sum(F.col("prior") * (1 - F.col("prior"))),
            F.count("*"), F.sum("level_n"), F.sum(F.col("level_n").cast("double") ** 2),
        ).first()
        weight = fitted_weight(spread or 0.0, noise or 0.0, rows or 0, size or 0, squares or 0.0)
        shrunk = (F.col("level_bad") + F.lit(weight) * F.col("prior")) / (F.col("level_n") + F.lit(weight))
        level_table = level_counts.select(*keys, shrunk.alias("parent"), F.lit(weight).alias("weight"), F.col("prior"))
        estimates = table.join(level_table, keys)
    a = F.col("bad") + F.col("weight") * F.col("prior")
    b = F.col("n") - F.col("bad") + F.col("weight") * (1 - F.col("prior"))
    return estimates.select("host", "n", "bad", F.col("parent").alias("estimate"), posterior_bound(a, b, F.lit(bound)).alias("lower"), F.lit(base).alias("base"))


def fitted_weight(spread: float, noise: float, rows: int, size: float, squares: float) -> float:
    """Prior sample size: with between-group variance v around a mean of variance s, the weight is s / v - 1."""
    if rows < 2 or noise <= 0 or size <= 0:
        return 10.0
    mean_noise = noise / rows
    excess = (spread - rows * mean_noise) / max(size - squares / size, 1e-9)
    return float(min(1000.0, max(1.0, mean_noise / excess - 1))) if excess > 0 else 1000.0


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, bound: float = BOUND, max_bad: float = MAX_BAD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's estimate and lower bound.

    ``outcomes`` has (host, bad: 0 or 1) for labelled pages.
    """
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    counts = outcomes.select("host", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("bad")).unionByName(
        seen.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    )
    hosts = written(reputation(counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), bound), "reputation")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    cut = F.least(F.lit(max_bad) * F.col("base"), F.lit(0.9))
    learned = F.when(F.col("lower") > cut, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(hosts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "estimate", "lower"
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of pages whose document is labelled: the number in a page's path is its document's id.

    A page is bad if its document has quality 0 or is toxic.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    known = labels.groupBy("doc_id").agg(F.min(bad).alias("bad"), F.max(bad).alias("most")).where("bad = most").select("doc_id", "bad")
    path = path_of(F.col("url"))
    number = F.regexp_extract(path, r"^/[a-z]{2}/(\d{1,18})(?:[/.].*)?$", 1)
    seen = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    return seen.join(known, "doc_id").select("host", "bad")
