"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed byte-pair counts (log, inverse document frequency, unit length) beside two
terms for the shares of words that repeat the word before and that don't. The latent space is the
leading right singular vectors of a sample of labelled rows, and so are the neighbours: at most
``SAMPLE`` rows with the smallest hash of their id, a documented bound on what is fitted and
broadcast (``SAMPLE`` x ``DIMENSIONS`` floats, under 1 MB). Every document is then compared with all
neighbours by blocked cosine products, and its score is the mean label of the ``NEIGHBOURS`` most
similar ones, weighted by the ``POWER``-th power of their similarity (negative counts as 0).

Defined results: null and empty texts, and all texts when there is no labelled row, get the sample's
share of good rows (0.5 without any); labels that contradict each other or are null teach nothing;
repeated rows are scored alike. Language, source, id and labels of a document are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import fold, utf8

TERMS = 2048
SAMPLE = 4000
DIMENSIONS = 32
NEIGHBOURS = 5
POWER = 8
BLOCK = 256
GOOD = 0.5
GRAM_ROWS = 250  # rows widened at once for the terms' Gram matrix, and its columns added up at once
GUARD = 96  # further directions that subspace iteration carries
ROUNDS = 300
CONVERGED = 1e-12  # residual over the largest eigenvalue

# Term of every byte pair, by multiplicative hashing.
PAIR_TERM = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int32) % TERMS


def counts(text: bytes) -> np.ndarray:
    """Counts of all byte-pair terms of a text, then the numbers of words that repeat and that don't."""
    out = np.zeros(TERMS + 2, np.float32)
    at = np.frombuffer(text, np.uint8).astype(np.int32)
    if len(at) > 1:
        out[:TERMS] = np.bincount(PAIR_TERM[at[:-1] * 256 + at[1:]], minlength=TERMS)
    words = text.split()
    repeats = sum(map(eq, words, words[1:]))
    out[TERMS:] = repeats, len(words) - repeats
    return out


def narrow(row: np.ndarray) -> bytes:
    """The counts that aren't 0 after their places: most texts have a few hundred of all terms."""
    at = np.flatnonzero(row).astype("<u2")
    return at.tobytes() + row[at].astype("<f4").tobytes()


def widen(packed: Sequence[bytes]) -> np.ndarray:
    rows = np.zeros((len(packed), TERMS + 2), np.float32)
    for row, data in zip(rows, packed):
        n = len(data) // 6
        row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return rows


def leading(gram: np.ndarray, dimensions: int) -> np.ndarray:
    """Unit eigenvectors of the largest eigenvalues, largest first, by subspace iteration to ``CONVERGED``.

    It holds some columns beside ``gram``; a full decomposition, which needs five times as much, is left
    to small matrices and to those whose eigenvalues lie too close.
    """
    wide = dimensions + GUARD
    if len(gram) > 2 * wide:
        basis = np.linalg.qr(np.random.default_rng(0).standard_normal((len(gram), wide)))[0]
        for _ in range(ROUNDS):
            image = gram @ basis
            values, turn = np.linalg.eigh(basis.T @ image)
            values, turn = values[::-1][:dimensions], turn[:, ::-1]
            found = basis @ turn[:, :dimensions]
            residual = np.linalg.norm(image @ turn[:, :dimensions] - found * values, axis=0)
            if residual.max(initial=0.0) <= CONVERGED * max(values.max(initial=0.0), 1e-300):
                return found
            basis = np.linalg.qr(image)[0]
    values, axes = np.linalg.eigh(gram)
    return axes[:, np.argsort(-values)[:dimensions]]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Space:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    @staticmethod
    def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
        return np.hstack([unit(np.log1p(rows[:, :TERMS]) * idf), unit(rows[:, TERMS:])]).astype(np.float32)

    @classmethod
    def fit(cls, rows: np.ndarray | list[bytes], labels: np.ndarray, dimensions: int) -> Space:
        """From rows of counts, or ``narrow`` ones: the driver widens ``GRAM_ROWS`` of them at a time."""

        def parts() -> Iterator[np.ndarray]:
            for at in range(0, len(rows), GRAM_ROWS):
                some = rows[at : at + GRAM_ROWS]
                yield some if isinstance(some, np.ndarray) else widen(some)

        met = sum(((some[:, :TERMS] > 0).sum(0) for some in parts()), np.zeros(TERMS, np.int64))
        idf = np.log((1 + len(rows)) / (1 + met)) + 1
        # Right singular vectors through the terms' Gram matrix, whose size is fixed.
        gram = np.zeros((TERMS + 2,) * 2)
        for some in parts():
            weighed = cls.weigh(some, idf).astype(np.float64)
            for at in range(0, len(gram), GRAM_ROWS):
                gram[at : at + GRAM_ROWS] += weighed[:, at : at + GRAM_ROWS].T @ weighed
        axes = leading(gram, dimensions).astype(np.float32)
        vectors = np.concatenate([np.zeros((0, axes.shape[1]), np.float32), *[cls.weigh(some, idf) @ axes for some in parts()]])
        return cls(idf.astype(np.float32), axes, unit(vectors), labels.astype(np.float32), float(labels.mean()) if len(labels) else 0.5)

    def scores(self, rows: np.ndarray, neighbours: int, power: int) -> np.ndarray:
        out = np.full(len(rows), self.share)
        full = rows[:, TERMS:].sum(1) > 0
        if not len(self.labels) or not full.any():
            return out
        near = np.maximum(unit(self.weigh(rows[full], self.idf) @ self.axes) @ self.vectors.T, 0)
        k = min(neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.take_along_axis(near, top, 1).astype(np.float64) ** power
        total = votes.sum(1)
        voted = (votes * self.labels[top]).sum(1) / np.maximum(total, 1e-300)
        out[full] = np.where(total > 0, voted, self.share)
        return np.clip(out, 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, folds: int = 3, left_out: int = 1) -> Space:
    """The space from labelled rows outside the left-out fold."""
    known = (
        labels.where(fold(folds) != left_out).groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most").select("doc_id", "label")
    )
    ids = docs.select("doc_id").join(known, "doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bound that makes the broadcast below small

    @F.pandas_udf(T.BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([narrow(counts(t)) for t in texts], dtype=object)

    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", utf8().alias("text"))
    once = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = once.select("label", packed("text").alias("terms"), "doc_id").orderBy("doc_id").toPandas()
    return Space.fit(list(rows.pop("terms")), rows["label"].to_numpy(float), dimensions)


def score_of(space: Space, docs: DataFrame, neighbours: int = NEIGHBOURS, power: int = POWER) -> Column:
    """The score of ``text`` as an expression on ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [np.zeros(0)]
            for at in range(0, len(texts), BLOCK):
                rows = np.stack([counts(t) for t in texts.iloc[at : at + BLOCK]])
                parts.append(shared.value.scores(rows, neighbours, power))
            yield pd.Series(np.concatenate(parts))

    return scored(utf8())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted."""
    value = score_of(learn(docs, labels), docs)
    return docs.select("doc_id", (fold(3) == 1).alias("held_out"), value.alias("score")).withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is below ``GOOD``."""
    return docs.where(score_of(learn(docs, labels), docs) >= GOOD)
