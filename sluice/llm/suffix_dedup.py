"""Suffix-array dedup: every byte covered by a ``LENGTH``-byte string that also starts earlier is removed.

Finding where equal strings can meet. The least hash of the ``GRAM``-byte grams in a ``LENGTH``-byte
window is the same for equal windows, so starts are cut into runs of one least hash and runs meet by
it. Runs whose hash stands nowhere else hold no repeated string and end there. The others are cut out
of their texts and sent to the bucket of their hash; equal runs of a batch send their bytes once.
A hash of very many runs would make one bucket large, though its runs differ around the gram: the
starts of such a run are divided by their distance to the gram, in steps that double from both ends,
and each part goes to the bucket of the bytes that all its windows must share.

In a bucket the runs are dealt into shards, a Burrows-Wheeler transform is built for each, and the
transforms are merged by interleave refinement (``bwt``). The repeated intervals tell for each start
whether its string also starts earlier. Spans come together by document and the text is cut.

Documents are ordered by doc_id, nulls first, then by a hash of the text. Defined results: a null text
is empty; texts shorter than ``LENGTH`` bytes stay whole; of rows equal in doc_id and text one counts
as the first, the others are removed as later copies; an empty table gives no rows; only doc_id and
text are read. The bytes left may be cut inside a character, so they are returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.bwt import Shard, repeated_intervals
from sluice.llm.common import utf8

LENGTH = 100
GRAM = 32
BLOCK = 1 << 20  # bytes hashed at once
LONGEST_RUN = 4096
HEAVY = 500  # runs of one hash in a batch that make it a hot hash at once
HOT = 20_000  # runs of one hash over all that make it a hot hash
SALTS = 64
BUCKET_BYTES = 1 << 20  # of text for each bucket
SHARD_BYTES = 1 << 18

KEY = ["has", "doc", "h"]
VALUE_BITS = 48  # of a gram's hash; equal hashes of other grams cost work, not results
TIE_BITS = 40  # of a text's hash that tell rows of one doc_id apart; rows without doc_id have all 64
HOT_MARK, TWICE_MARK = -2, -1  # in place of a start
RUNS = "value long, salt int, doc long, h long, at long"
PIECES = "bucket long, has boolean, doc long, h long, start int, n int, piece binary"
SPANS = "has boolean, doc long, h long, lo int, hi int"
RESULT = "has boolean, doc long, n_bytes long, n_removed long, n_spans long, kept binary"


class Grams:
    """Rolling hashes of all grams of a buffer, from prefix sums of a polynomial modulo 2^64, and window minima."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, gram: int, length: int):
        self.gram, self.window = gram, length - gram + 1
        self.powers = self.series(self.BASE, 0)
        self.inverses = self.series(self.INVERSE, 0)

    @staticmethod
    def series(base: int, n: int) -> np.ndarray:
        steps = np.full(n + 1, np.uint64(base), np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) <= n:
            self.powers, self.inverses = self.series(self.BASE, 2 * n), self.series(self.INVERSE, 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: n - self.gram + 1]) * self.inverses[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def least(self, h: np.ndarray) -> np.ndarray:
        """Minimum of every ``window`` neighbours."""
        have, low = 1, h
        while have * 2 <= self.window:
            low = np.minimum(low[have:], low[:-have])
            have *= 2
        rest = self.window - have
        return np.minimum(low[rest:], low[:-rest]) if rest else low


def cut_blocks(texts: list[bytes], length: int, block: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in groups of about ``block`` bytes; a long text goes in blocks that share length - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), block):
            part = text[at : at + block + length - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= block:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_runs(grams: Grams, texts: list[bytes], length: int, block: int, longest: int) -> tuple[np.ndarray, ...]:
    """(value, text, start, starts, again): maximal runs of starts with one least hash; again: it stands twice in the run."""
    found = [[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool)]]
    for parts in cut_blocks(texts, length, block):
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        h = grams.hashes(data)
        low = grams.least(h)
        sizes = np.array([len(p) for _, _, p in parts])
        base = np.cumsum(sizes) - sizes
        valid = np.ones(len(low), bool)
        for b in base[1:]:
            valid[b - length + 1 : b] = False
        new = valid.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        stop = np.ones(len(low) + 1, bool)
        stop[: len(low)] = new | ~valid
        stops = np.flatnonzero(stop)
        n = stops[np.searchsorted(stops, first, side="right")] - first
        if (n > longest).any():
            pieces = -(-n // longest)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, n = np.repeat(first, pieces) + nth * longest, np.minimum(np.repeat(n, pieces) - nth * longest, longest)
        value = low[first]
        again = np.zeros(len(first), bool)
        for i in range(0, len(first), 1 << 14):
            at = first[i : i + (1 << 14)]
            place = (h[at[:, None] + np.arange(grams.window)] == value[i : i + (1 << 14), None]).argmax(axis=1)
            again[i : i + (1 << 14)] = n[i : i + (1 << 14)] - 1 > place
        part = np.searchsorted(base, first, side="right") - 1
        text = np.array([i for i, _, _ in parts])[part]
        start = first - base[part] + np.array([a for _, a, _ in parts])[part]
        found.append([(value >> np.uint64(64 - VALUE_BITS)).astype(np.int64), text, start, n, again])
    return tuple(np.concatenate(column) for column in zip(*found))


def packed(start: np.ndarray, n: np.ndarray, has: np.ndarray) -> np.ndarray:
    """start, then 13 bits of n (LONGEST_RUN at most), then whether there is a doc_id."""
    return (start << 14) + (n << 1) + has


def run_rows(length: int, gram: int, heavy_from: int, block: int, longest: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The runs of all texts, packed as ``at``; rows with a mark in place of the start say that a hash is hot or repeats inside one run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(gram, length)
        for batch in batches:
            value, text, start, n, again = find_runs(grams, batch["text"].tolist(), length, block, longest)
            if not len(value):
                continue
            distinct, which, count = np.unique(value, return_inverse=True, return_counts=True)
            heavy = count[which] >= heavy_from
            has, doc, h = (batch[c].to_numpy()[text] for c in KEY)
            marks = np.concatenate([distinct[count >= heavy_from], value[again]])
            what = np.repeat([HOT_MARK, TWICE_MARK], [int((count >= heavy_from).sum()), int(again.sum())])
            none = np.zeros(len(marks), np.int64)
            yield pd.DataFrame({
                "value": np.concatenate([value, marks]),
                "salt": np.concatenate([np.where(heavy, 1 + np.arange(len(value)) % SALTS, 0), none]),
                "doc": np.concatenate([doc, none]),
                "h": np.concatenate([h, none]),
                "at": np.concatenate([packed(start, n, has), packed(what, none, none)]),
            })

    return run


def distance_edges(window: int) -> np.ndarray:
    """Distances 0 to window - 1 in steps that double from both ends: 0, 1, 2, 4 ... and so backwards."""
    steps = [0, *(1 << i for i in range(window.bit_length()) if 1 << i <= window // 2)]
    return np.unique([*steps, *(window - s for s in steps)])


def divide(grams: Grams, edges: np.ndarray, piece: bytes, value: int, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(shared bytes, first start, starts) of the parts of a hot run."""
    h = grams.hashes(np.frombuffer(piece, np.uint8))
    spots = np.flatnonzero(h >> np.uint64(64 - VALUE_BITS) == np.uint64(value))
    starts = np.arange(len(piece) - length + 1)
    gram = spots[np.searchsorted(spots, starts)]
    step = np.searchsorted(edges, gram - starts, side="right") - 1
    cuts = np.flatnonzero((np.diff(gram) != 0) | (np.diff(step) != 0)) + 1
    for first, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)]):
        at, k = int(gram[first]), int(step[first])
        shared = piece[at - int(edges[k]) : at + length - int(edges[k + 1]) + 1]
        yield bytes([k]) + shared, first, stop - first


def cut_pieces(length: int, gram: int, buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The bytes of repeated runs by bucket. Equal ones of a batch are sent once, by the earliest; the others only say where
    they stand (no bytes), in any bucket, because all their strings start earlier."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(gram, length)
        edges = distance_edges(grams.window)
        for batch in batches:
            batch = batch.sort_values(KEY, ignore_index=True)
            seen: set[tuple[int, bytes]] = set()
            rows = []
            for has, doc, h, text, spots in zip(*(batch[c] for c in [*KEY, "text", "spots"])):
                copied = None  # (first, stop) of starts whose bytes an earlier row of the batch carries
                for spot in sorted(spots, key=lambda s: s["at"]):
                    start, n, value = spot["at"] >> 14, spot["at"] >> 1 & 8191, spot["value"]
                    piece = text[start : start + n + length - 1]
                    parts = [(None, 0, n)] if not spot["hot"] else divide(grams, edges, piece, value, length)
                    for shared, first, count in parts:
                        if shared is None:
                            bucket, own = value % buckets, piece
                        else:
                            bucket = int.from_bytes(hashlib.blake2b(shared, digest_size=7).digest()) % buckets
                            own = piece[first : first + count + length - 1]
                        if (bucket, own) not in seen:
                            seen.add((bucket, own))
                            rows.append((bucket, has, doc, h, start + first, count, own))
                        elif copied and copied[1] == start + first:
                            copied = (copied[0], start + first + count)
                        else:
                            if copied:
                                rows.append((h % buckets, has, doc, h, copied[0], copied[1] - copied[0], None))
                            copied = (start + first, start + first + count)
                if copied:
                    rows.append((h % buckets, has, doc, h, copied[0], copied[1] - copied[0], None))
            if rows:
                yield pd.DataFrame(rows, columns=["bucket", *KEY, "start", "n", "piece"])

    return run


def bucket_spans(length: int, shard_bytes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The spans of one bucket whose strings also start earlier."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*KEY, "start"], ignore_index=True)
        has, doc, h = (rows[c].to_numpy() for c in KEY)
        start, n = rows["start"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (has[1:] != has[:-1]) | (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        place = (np.cumsum(fresh) << 32) + start
        # The first row of a piece stands for it; its other rows are covered whole.
        first_of: dict[bytes, int] = {}
        covered = np.zeros(len(rows), bool)
        lacking = rows["piece"].isna().to_numpy()
        for i, piece in enumerate(rows["piece"]):
            if lacking[i] or piece in first_of and place[first_of[piece]] < place[i]:
                covered[i] = True
            else:
                first_of.setdefault(piece, i)
        shards, held, size = [], [], 0
        for piece in first_of:
            held.append(piece)
            size += len(piece)
            if size >= shard_bytes:
                shards.append(Shard(held))
                held, size = [], 0
        if held:
            shards.append(Shard(held))
        row = np.fromiter(first_of.values(), np.int64, len(first_of))
        owner, offset, interval = repeated_intervals(shards, length)
        lo, hi, of = [start[covered]], [start[covered] + n[covered] + length - 1], [np.flatnonzero(covered)]
        if len(owner):
            at = place[row[owner]] + offset
            earliest = np.minimum.reduceat(at, np.flatnonzero(np.diff(interval, prepend=interval[0] - 1)))
            later = at > earliest[interval - interval[0]]
            code = np.sort((row[owner[later]] << 32) + offset[later])
            breaks = np.append(True, np.diff(code) > 1) if len(code) else np.zeros(0, bool)
            begin, end = code[breaks], code[np.append(breaks[1:], True)] if len(code) else code
            of.append(begin >> 32)
            lo.append(start[begin >> 32] + (begin & 0xFFFFFFFF))
            hi.append(start[end >> 32] + (end & 0xFFFFFFFF) + length)
        of = np.concatenate(of)
        return pd.DataFrame({"has": has[of], "doc": doc[of], "h": h[of], "lo": np.concatenate(lo), "hi": np.concatenate(hi)})

    return run


def cut_texts(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The bytes of every text outside its spans, and how many maximal runs were removed; later copies of a row go whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for has, doc, text, copy, spans in zip(*(batch[c] for c in ["has", "doc", "text", "copy", "spans"])):
                found = sorted((s["lo"], s["hi"]) for s in (spans if spans is not None else ()))
                if copy > 1 and len(text) >= length:
                    found = [(0, len(text))]
                kept, upto, count = [], 0, 0
                for lo, hi in found:
                    if lo > upto or not count:
                        kept.append(text[upto:lo])
                        count += 1
                    upto = max(upto, hi)
                rest = b"".join([*kept, text[upto:]])
                out.append((has, doc, len(text), len(text) - len(rest), count, rest))
            yield pd.DataFrame(out, columns=["has", "doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    hashed = F.xxhash64(utf8())
    return docs.select(
        F.col("doc_id").isNotNull().alias("has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.when(F.col("doc_id").isNull(), hashed).otherwise(hashed.bitwiseAND((1 << TIE_BITS) - 1)).alias("h"), utf8().alias("text"),
    )


def spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(has, doc, h, lo, hi): byte spans of ``keyed`` texts that also stand earlier; spans may overlap."""
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + volume // BUCKET_BYTES
    runs = texts.where(F.octet_length("text") >= length).mapInPandas(run_rows(length, gram, HEAVY, BLOCK, LONGEST_RUN), RUNS)
    total: Column = F.expr("count(*) over (partition by value, salt)")
    marked: Column = F.expr("min(at) over (partition by value, salt)")
    repeated = (
        runs.withColumn("total", total).withColumn("marked", marked)
        .where((F.col("at") >= 0) & ((F.col("salt") > 0) | (F.col("total") > 1)))
        .withColumn("hot", (F.col("salt") > 0) | (F.col("total") >= HOT) | (F.shiftright("marked", 14) == HOT_MARK))
        .withColumn("has", F.col("at") % 2 == 1)
    )
    spots = repeated.groupBy(*KEY).agg(F.collect_set(F.struct("at", "value", "hot")).alias("spots"))
    pieces = texts.join(spots.hint("merge"), KEY).mapInPandas(cut_pieces(length, gram, buckets), PIECES)
    return pieces.groupBy("bucket").applyInPandas(bucket_spans(length, SHARD_BYTES), SPANS)


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the bytes kept."""
    texts = keyed(docs)  # dealt by document once: both joins read the same exchange
    by_doc = spans(texts, length, gram).groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    # Rows equal in doc_id and text share their spans; all but one are later copies.
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    rows = texts.join(by_doc.hint("merge"), KEY, "left").withColumn("copy", nth).mapInPandas(cut_texts(length), RESULT)
    return rows.select(F.when(F.col("has"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
