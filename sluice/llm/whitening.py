"""Embedding whitening by spectrum slicing of the exact covariance.

Entries become integers, ``floor(64 c) + 1000000``. Sums per dimension and then products of entries
centred by the whole part of their mean are added up over all vectors as integers, so every entry of
the covariance is the right double of an exact fraction. Its leading eigenvalues are isolated by
inertia counts: the LDLᵀ pivots of ``V - sigma I`` tell how many eigenvalues lie above ``sigma``.
Rayleigh quotient iteration then converges inside the isolating interval, and two counts beside the
result certify its number. The driver holds the covariance, dimension by dimension, never vectors.

Defined results: vectors that are null, empty or hold a null or non-finite entry are dropped; so are
vectors whose length isn't the commonest (ties: the longest); entries beyond a long are cut to its ends;
rows that repeat all count, each with its own rows of the result; components whose eigenvalue is zero
to double precision can't be whitened and are left out; eigenvalues closer than double precision tells
apart share their space, any orthonormal basis of it being right; a ``deviation`` beyond a long is null;
an empty table gives no rows; only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
STEPS = 64
OFFSET = 1_000_000
EPS = np.finfo(float).eps
LONG = (1 << 63) - 1
HALF = 10**18  # sums of products travel in two decimals
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def remaining(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, x): vectors without null or non-finite entries as arrays of integers of one length."""
    value = F.col(f"`{column}`")
    finite = ~F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(value, lambda c: F.least(F.floor(c.cast("double") * STEPS), F.lit(LONG - OFFSET)) + OFFSET)
    rows = vectors.where(value.isNotNull() & (F.size(value) > 0) & finite).select(F.col(f"`{key}`").alias("vec_id"), x.alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def wide(matrix: np.ndarray, limit: int) -> np.ndarray:
    """The integers themselves where sums of them stay below 2^62, else Python integers."""
    return matrix if limit < 1 << 62 else matrix.astype(object)


def sums(column: str = "x"):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch[column].to_numpy()).astype(np.int64)
                part = wide(x, len(x) * (int(np.abs(x // 2).max()) + 1) * 2).sum(axis=0).astype(object)
                total = part if total is None else total + part
                n += len(x)
        if n:
            yield pd.DataFrame({"j": range(len(total)), "n": n, "s": [Decimal(int(v)) for v in total]})

    return run


def centred(batch: pd.DataFrame, middle: np.ndarray) -> np.ndarray:
    x = np.stack(batch["x"].to_numpy()).astype(np.int64)
    limit = int(np.abs(x // 2).max()) * 2 + 2 + int(max(abs(int(m)) for m in middle))
    return wide(x, limit) - wide(middle, limit)


def products(middle: np.ndarray):
    """Per task the sums of products of centred entries, exact: doubles below 2^53, else Python integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                y = centred(batch, middle)
                most = max(1, int(np.abs(y).max()))
                if most * most * len(y) < 1 << 53:
                    doubles = y.astype(float)
                    part = (doubles.T @ doubles).astype(np.int64).astype(object)
                else:
                    exact = y.astype(object)
                    part = exact.T @ exact
                total = part if total is None else total + part
        if total is not None:
            j, k = np.triu_indices(len(total))
            halves = [divmod(int(v), HALF) for v in total[j, k]]
            yield pd.DataFrame({"j": j, "k": k, "high": [Decimal(v) for v, _ in halves], "low": [Decimal(v) for _, v in halves]})

    return run


def inertia(matrix: np.ndarray, sigma: float) -> int:
    """Eigenvalues of the symmetric ``matrix`` above ``sigma``: positive pivots of LDLᵀ with blocks of one or two."""
    a = matrix - sigma * np.eye(len(matrix))
    bound = (1 + 17**0.5) / 8
    above = 0
    while len(a):
        column = np.abs(a[1:, 0])
        largest = column.max() if len(column) else 0.0
        first = abs(a[0, 0])
        pair = False
        if largest > 0 and first < bound * largest:
            r = 1 + int(column.argmax())
            off = np.abs(a[r]).copy()
            off[r] = 0
            if first * off.max() >= bound * largest**2:
                pass
            elif abs(a[r, r]) >= bound * off.max():
                a[[0, r]] = a[[r, 0]]
                a[:, [0, r]] = a[:, [r, 0]]
            else:
                pair = True
                a[[1, r]] = a[[r, 1]]
                a[:, [1, r]] = a[:, [r, 1]]
        if pair:
            block, rest = a[:2, :2], a[2:, :2]
            above += 1  # such a block is indefinite: one pivot of each sign
            a = a[2:, 2:] - rest @ np.linalg.solve(block, rest.T)
        else:
            above += a[0, 0] > 0
            rest = a[1:, 0]
            a = a[1:, 1:] - (np.outer(rest, rest) / a[0, 0] if a[0, 0] else 0)
        a = (a + a.T) / 2
    return int(above)


class Slices:
    """Inertia counts tried so far, as brackets of the i-th eigenvalue."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        radius = np.abs(matrix).sum(axis=1).max()
        margin = radius * 1e-6 + np.finfo(float).tiny
        self.counts = {-radius - margin: len(matrix), radius + margin: 0}
        self.least = 8 * EPS * radius

    def count(self, sigma: float) -> int:
        if sigma not in self.counts:
            self.counts[sigma] = inertia(self.matrix, sigma)
        return self.counts[sigma]

    def bracket(self, i: int) -> tuple[float, float]:
        return max(s for s, c in self.counts.items() if c >= i), min(s for s, c in self.counts.items() if c < i)

    def alone(self, i: int) -> bool:
        low, high = self.bracket(i)
        return self.counts[low] == i and self.counts[high] == i - 1

    def halve(self, i: int) -> bool:
        """False when the bracket is as narrow as doubles can tell."""
        low, high = self.bracket(i)
        if high - low <= self.least or not low < (middle := (low + high) / 2) < high:
            return False
        self.count(middle)
        return True


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above zero, falling, and their unit vectors as columns.

    Raises ArithmeticError when the counts beside a result don't certify its number.
    """
    d = len(matrix)
    slices = Slices(matrix)
    zero = 8 * d * EPS * max(np.trace(matrix), 0)
    values, vectors = [], np.zeros((d, 0))
    random = np.random.default_rng(1)
    for i in range(1, min(most, d, slices.count(zero)) + 1):
        while not slices.alone(i) and slices.halve(i):
            pass
        value, vector = converge(slices, i, vectors, random)
        spread = slices.least + 2 * np.abs(matrix @ vector - value * vector).max() * d**0.5
        if not slices.count(value - spread) >= i > slices.count(value + spread):
            raise ArithmeticError(f"eigenvalue {i} isn't certified by the counts beside {value}")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def converge(slices: Slices, i: int, found: np.ndarray, random: np.random.Generator) -> tuple[float, np.ndarray]:
    """Inverse iteration at the middle of the bracket, then Rayleigh quotients while they stay inside it."""
    matrix, unit = slices.matrix, np.eye(len(slices.matrix))

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found @ (found.T @ v)
        return v / np.linalg.norm(v)

    def solve(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            return clean(np.linalg.solve(matrix - shift * unit, v))
        except np.linalg.LinAlgError:
            return clean(np.linalg.solve(matrix - (shift + slices.least) * unit, v))

    while True:
        low, high = slices.bracket(i)
        middle = (low + high) / 2
        v = clean(random.standard_normal(len(matrix)))
        for _ in range(3):
            v = solve(middle, v)
        best = (np.inf, middle, v)
        for _ in range(12):
            rho = float(v @ matrix @ v)
            if not low - slices.least <= rho <= high + slices.least:
                break
            off = float(np.linalg.norm(matrix @ v - rho * v))
            if off >= best[0] / 2:
                break
            best = (off, rho, v)
            v = solve(rho, v)
        if best[0] <= 64 * slices.least or not slices.halve(i):
            if best[0] == np.inf:
                best = (0.0, float(v @ matrix @ v), v)
            return best[1], best[2]


class Whitener:
    """What the tasks need: whole and broken part of the means, projections over the deviations."""

    def __init__(self, n: int, middle: np.ndarray, broken: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.middle, self.broken = n, middle, broken
        self.fraction = broken.astype(float) / n
        self.projection = vectors / np.sqrt(values)
        self.explained = values / trace
        self.values, self.vectors = values, vectors

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(float) - self.fraction) @ self.projection

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """sum over dimensions of (n x - S)^2."""
        most = self.n * (int(np.abs(y).max()) + 1)
        if most * most * y.shape[1] <= LONG:
            off = self.n * y.astype(np.int64) - self.broken.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * y.astype(object) - self.broken
        return [int(v) if v <= LONG else None for v in (off * off).sum(axis=1)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitening of all ``rows`` (vec_id, x). None when nothing varies."""
    firsts = rows.select("x").mapInPandas(sums(), "j int, n long, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("j").collect()
    if not firsts:
        return None
    n = firsts[0]["n"]
    totals = [int(r["s"]) for r in firsts]
    middle = np.array([s // n for s in totals], np.int64)
    broken = np.array([s % n for s in totals], object)
    seconds = rows.select("x").mapInPandas(products(middle), "j int, k int, high decimal(38,0), low decimal(38,0)").groupBy("j", "k").agg(F.sum("high"), F.sum("low")).collect()
    d = len(totals)
    covariance = np.zeros((d, d))
    for j, k, high, low in seconds:
        g = int(high) * HALF + int(low)
        covariance[j, k] = covariance[k, j] = float(Fraction(n * g - int(broken[j]) * int(broken[k]), n * n))
    values, vectors = leading(covariance, components)
    return Whitener(n, middle, broken, values, vectors, float(np.trace(covariance))) if len(values) else None


def identity_error(rows: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = 0.0, 0.0
        for batch in batches:
            if len(batch):
                w = whitener.whiten(centred(batch, whitener.middle))
                first, second = first + w.sum(axis=0), second + w.T @ w
        if not np.isscalar(first):
            size = len(first)
            j, k = np.indices((size, size)).reshape(2, -1)
            yield pd.DataFrame({"j": np.append(j, np.full(size, -1)), "k": np.append(k, np.arange(size)), "s": np.append(second.ravel(), first)})

    parts = rows.select("x").mapInPandas(run, "j int, k int, s double").groupBy("j", "k").agg(F.sum("s").alias("s")).collect()
    size = len(whitener.values)
    mean, covariance = np.zeros(size), np.zeros((size, size))
    for j, k, s in parts:
        if j < 0:
            mean[k] = s / whitener.n
        else:
            covariance[j, k] = s / whitener.n
    return float(np.abs(covariance - np.outer(mean, mean) - np.eye(size)).max())


def apply(rows: DataFrame, whitener: Whitener, error: float) -> DataFrame:
    """(vec_id, n, deviation, whitened: array, explained: array, identity_error)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = centred(batch, whitener.middle)
                yield pd.DataFrame({
                    "vec_id": batch["vec_id"], "deviation": pd.array(whitener.deviations(y), dtype="Int64"), "w": list(whitener.whiten(y)),
                })

    return rows.mapInPandas(run, "vec_id long, deviation long, w array<double>").select(
        "vec_id", F.lit(whitener.n).cast("long").alias("n"), "deviation", "w",
        F.array(*map(F.lit, whitener.explained.tolist())).alias("e"), F.lit(error).alias("identity_error"),
    )


def long_form(whitened: DataFrame) -> DataFrame:
    """One row per vector and component."""
    each: Column = F.posexplode(F.arrays_zip("w", "e"))
    return whitened.select("vec_id", "n", "deviation", "identity_error", each.alias("at", "pair")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("pair.w").alias("whitened"), F.col("pair.e").alias("explained"), "identity_error",
    )


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every remaining vector projected on the leading components, with unit variance."""
    rows = remaining(vectors, key, column)
    whitener = fit(rows, components)
    if whitener is None:
        return vectors.sparkSession.createDataFrame([], ROWS)
    return long_form(apply(rows, whitener, identity_error(rows, whitener)))
