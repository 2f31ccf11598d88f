"""Byte-pair encoding by forced-boundary splitting, and decoding.

A vocabulary file of the public tokenizers is read as data: its merges, its ids and its added
tokens. Texts are cut into pre-tokens by the byte-level pattern. Inside a pre-token a pair of
neighbouring bytes that stands inside no vocabulary token is a certain cut: no merge can ever cross
it, so the fragments on both sides are encoded independently and their ids are put one after the
other. Fragments and pre-tokens met before come from a bounded memory. Defined results: null and
empty texts have no ids; repeated rows are encoded alike; long fragments merge in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Remembered

# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and forced boundaries of a byte-level BPE file given as text."""

    def __init__(self, text: str):
        model = json.loads(text)
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        vocab: dict[str, int] = model["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.token: dict[int, bytes] = {n: spelled(t) for t, n in vocab.items() if t not in self.added}
        self.token |= {n: t.encode() for t, n in self.added.items()}
        self.single = {self.token[n][0]: n for n in vocab.values() if len(self.token[n]) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        inside = {t[i : i + 2] for n, t in self.token.items() for i in range(len(t) - 1) if n not in self.added.values()}
        self.inside = frozenset(inside)
        self.pretokens = regex.compile(PATTERN)
        chosen = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.added_pattern = regex.compile(f"({chosen})") if chosen else None
        self.fragment = Remembered(self.encode_fragment)
        self.pretoken = Remembered(self.encode_pretoken)

    def encode_fragment(self, piece: bytes) -> bytes:
        """Ids (packed, 32 bits each) of bytes without a certain cut: lowest rank first, leftmost first."""
        ids = [self.single[b] for b in piece]
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        waiting = [(*self.merge[ids[i], ids[i + 1]], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (ids[i], ids[i + 1]) in self.merge]
        waiting = [(rank, i, new, left, right) for rank, new, i, left, right in waiting]
        heapq.heapify(waiting)
        while waiting:
            _, i, new, left, right = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := self.merge.get((ids[a], ids[b]))):
                    heapq.heappush(waiting, (found[0], a, found[1], ids[a], ids[b]))
        return array("I", [n for n in ids if n >= 0]).tobytes()

    def encode_pretoken(self, word: str) -> bytes:
        text = word.encode()
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside]
        ends = [0, *cuts, len(text)]
        return b"".join([self.fragment[text[a:b]] for a, b in zip(ends, ends[1:])])

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; added tokens keep their ids wherever they stand."""
        parts = self.added_pattern.split(text) if self.added_pattern and text else [text]
        pretoken, split = self.pretoken, self.pretokens.findall
        out: list[bytes] = []
        for part in parts:
            if part in self.added:
                out.append(array("I", [self.added[part]]).tobytes())
            else:
                out += [pretoken[w] for w in split(part)]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def digest(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Per document: n_tokens, sha256 of the ids and of the text decoded from them. The file is read on the driver."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(vocabulary_file).read_text(encoding="utf-8"))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                ids = vocabulary.encode(text)
                back = vocabulary.decode(ids).encode()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", coded(text).alias("coded")).select("doc_id", "coded.*")


def encode(docs: DataFrame, vocabulary_file: str, column: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array in ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_file).read_text(encoding="utf-8"))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(shared.value)
        for texts in batches:
            yield pd.Series([array("i", vocabulary.encode(t)).tolist() for t in texts], dtype=object)

    return docs.withColumn(column, ids(F.coalesce(F.col("text"), F.lit(""))))


def decode(docs: DataFrame, vocabulary_file: str, column: str = "token_ids", into: str = "decoded") -> DataFrame:
    """The inverse of ``encode``; null ids stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_file).read_text(encoding="utf-8"))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(shared.value)
        for rows in batches:
            yield pd.Series([None if r is None else vocabulary.decode(array("I", [int(n) for n in r]).tobytes()) for r in rows], dtype=object)

    return docs.withColumn(into, text(F.col(column)))
