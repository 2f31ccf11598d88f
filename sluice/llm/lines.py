"""Fuzzy line deduplication by MinHash.

Lines (between line feeds, ASCII white space trimmed at both ends, lower-cased) that aren't empty are compared.
Equal lines of any length are one line with its first place; this needs no shingles. The shingles of a line are
the hashes of every ``SHINGLE`` neighbouring characters; a shorter line is its own one shingle, so only equal
lines are alike to it and it has no bands. Each of ``BANDS`` bands holds the minima of ``ROWS`` orders of its own,
so bands are independent: two lines of Jaccard similarity s agree in one with probability s^4, at s = 0.8
in some band of 8 with 0.985, at 0.9 with 0.9998. Shingles are hashed in pandas UDFs.

The minima also give a sketch: two bits of each. Lines whose sketches agree in fewer than ``AGREE`` places are
left out (similarity 0.8 keeps a pair of a shared band with 0.997), all others are told by the exact Jaccard
similarity of their shingle sets; connected lines form a component. Only keys that several lines share are kept.
In ``STARS`` rounds every line of a bucket is held against the bucket's first one; those that agree leave, the
others meet again. Then the lines of a bucket outside its largest component are held against all lines
of the bucket in other components, in blocks of ``BLOCK`` lines; pairs in one component need no link. No table of
these pairs is made: only lines that agree with some other one travel with their texts to their block, where they are told. One
line of a component stays: the one with the smallest doc_id (nulls first) and position. Texts of lines are
fetched for lines that agree, twice in all; the tables of a run are deleted when its decisions are written, shuffle files as each step ends.

Defined results: null and empty texts stay as they are; blank lines are never dropped; a text from which nothing goes is unchanged;
otherwise the lines that stay are joined by line feeds, and a document that loses all its text goes.
Rows that repeat entirely (same id and text) count as one document and keep their rows alike. Lines
are told apart by 64-bit hashes. Only doc_id, text and n_chars (counted anew if there) are touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from sluice.llm.common import components
from sluice.llm.winnow import let
from sluice.session import SCRATCH, arrow_batches, lean_shuffles, scratch, work_folder, written

SHINGLE = 5
BANDS = 8
ROWS = 4
SIMILARITY = 0.8
STARS = 3
AGREE = 22  # of the BANDS * ROWS places of a sketch
BLANKS = " \t\n\v\f\r"  # as in the rest of the subpackage: x20, x09 to x0D
BLOCK = 1000
BITMAP_ROWS = 1 << 18  # of 64 bits each, whatever the table's size
CHUNK_CHARS = 1 << 16  # hashed at once, so that arrays stay in the processor's cache
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
ORDERS = np.random.default_rng(10).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunks(lines: list[str]) -> Iterator[list[str]]:
    """The lines in runs of some CHUNK_CHARS characters."""
    held, size = [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    return x ^ (x >> np.uint64(29))


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every SHINGLE neighbouring characters of the lines, one after the other, and each line's first place."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    rolled = codes[: len(codes) - SHINGLE + 1].copy()
    for j in range(1, SHINGLE):
        rolled *= MIX[1]
        rolled += codes[j : len(codes) - SHINGLE + 1 + j]
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    for j in range(1, SHINGLE):
        inside[ends - j] = False  # begins less than a shingle before the line's end
    counts = sizes - SHINGLE + 1
    return mixed(rolled[inside[: len(rolled)]]), np.cumsum(counts) - counts


def keys_of(lines: list[str]) -> np.ndarray:
    """A key per line and band, a hash of the minima in the band's orders, and last the sketch: two bits of every minimum."""
    hashes, begins = shingles(lines)
    ordered, out = np.empty_like(hashes), np.empty((len(lines), BANDS + 1), np.uint64)
    sketch = np.zeros(len(lines), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band, np.uint64)
        for order in ORDERS[band * ROWS : (band + 1) * ROWS]:
            np.multiply(hashes, order, out=ordered)
            least = np.minimum.reduceat(ordered, begins)
            key = mixed(key * MIX[1] + least)
            sketch = sketch << np.uint64(2) | mixed(least) & np.uint64(3)
        out[:, band] = key
    out[:, BANDS] = sketch
    return out.view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def band_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The keys of a line's bands and its sketch; none for a line of fewer than SHINGLE characters."""
    for lines in batches:
        held = [line for line in lines if len(line) >= SHINGLE]
        keys = (key for part in chunks(held) for key in keys_of(part))
        yield pd.Series([next(keys) if len(line) >= SHINGLE else None for line in lines], dtype=object)


def agree(one: str, other: str) -> Column:
    """Whether two sketches hold the same two bits in at least AGREE places; a missing one agrees with all."""
    odd = F.expr(f"shiftrightunsigned({one} ^ {other}, 1) | ({one} ^ {other})").bitwiseAND(F.lit(0x5555555555555555))
    return F.coalesce(F.bit_count(odd) <= BANDS * ROWS - AGREE, F.lit(True))


@F.pandas_udf(BooleanType())
def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether the shingle sets of two lines have a Jaccard similarity of at least SIMILARITY."""
    for one, other in batches:
        sets = {line: np.unique(shingles([line])[0]) for line in {*one, *other}}
        told = []
        for a, b in zip(one, other):
            x, y = sets[a], sets[b]
            fits = min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y))
            both = len(np.intersect1d(x, y, assume_unique=True)) if fits else 0
            told.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield pd.Series(told, dtype=bool)


def keyed(docs: DataFrame) -> DataFrame:
    """The row, its text and the key of a document: id (nulls first) and hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"),
    )


def exploded(base: DataFrame) -> DataFrame:
    """Lines that are compared, with their places and hashes."""
    lines = base.select("k1", "k2", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "raw"))
    trimmed = lines.select("k1", "k2", "pos", F.btrim("raw", F.lit(BLANKS)).alias("line")).where("line <> ''")
    return trimmed.withColumn("h", F.xxhash64("line"))


def likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may be among those of ``wanted``: a bitmap of fixed size spares the shuffle of most others."""
    part, bit = F.col(column).bitwiseAND(F.lit(BITMAP_ROWS - 1)), F.shiftrightunsigned(column, 18).bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    met = rows.withColumn("part", part).withColumn("bit", bit).join(F.broadcast(bits), "part")
    return met.where(F.expr("shiftrightunsigned(bits, bit) & 1L = 1L")).select(*rows.columns)


def crowded(rows: DataFrame) -> DataFrame:
    """The rows (key, h, sketch) of buckets of several lines."""
    shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    return written(likely(rows, shared, "key").join(shared, "key"), "buckets")


def starred(rows: DataFrame) -> DataFrame:
    """Rows but the first of every bucket, with the bucket's first line and its sketch."""
    first = rows.groupBy("key").agg(F.min(F.struct("h", "sketch")).alias("first"))
    return rows.join(first, "key").select("key", "h", "sketch", F.col("first.h").alias("first"), F.col("first.sketch").alias("first_sketch")).where("h <> first")


def apart(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, block, turn, h, root, sketch, outside): lines of a bucket (key, h, sketch) that agree with one in another component of the links, by pairs of blocks."""
    told = rows.join(components(linked).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    counts = told.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("roots")
    )
    split = counts.where("roots > 1").select("key", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
    met = written(told.join(split, "key"), "buckets")
    block = F.pmod(F.xxhash64("h"), "blocks").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    outside = met.where("root <> main").select("key", block.alias("block"), every.alias("turn"), "h", "root", "sketch")
    anyone = met.select("key", block.alias("turn"), every.alias("block"), "h", "root", "sketch").select(outside.columns)
    one, other = outside.alias("one"), anyone.alias("other")
    alike = F.expr("one.key = other.key AND one.block = other.block AND one.turn = other.turn AND one.root <> other.root") & agree("one.sketch", "other.sketch")
    # Semi joins end at a line's first partner, so they make no more rows than there are lines.
    return one.join(other, alike, "left_semi").withColumn("outside", F.lit(True)).union(other.join(one, alike, "left_semi").withColumn("outside", F.lit(False)))


def texts_of(wanted: DataFrame, base: DataFrame) -> DataFrame:
    """(h, line) of the wanted lines (h)."""
    texts = likely(exploded(base).select("h", "line"), wanted, "h").groupBy("h").agg(F.first("line").alias("line"))
    return written(texts.join(wanted, "h", "left_semi"), "texts")


def verified(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILARITY."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    texts = texts_of(written(pairs.select("a").union(pairs.select("b")).distinct().toDF("h"), "wanted"), base)
    met = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(
        texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b"
    )
    return written(met.where(similar("line_a", "line_b")).select("a", "b"), "links")


def crosswise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar lines (a, b) of different components that agree, one outside and one not, of frames sorted by key, block and turn."""

    def told(frame: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        h, root, outside = (frame[name].to_numpy() for name in ("h", "root", "outside"))
        sketch, sets = frame["sketch"].to_numpy().view(np.uint64), []
        for part in chunks(frame["line"].to_list()):
            hashes, firsts = shingles(part)
            sets += [np.unique(own) for own in np.split(hashes, firsts[1:])]
        out = []
        for start, end in zip(begins, [*begins[1:], len(frame)]):
            pairs = crossed(root[start:end], sketch[start:end], outside[start:end], sets[start:end])
            out += [(max(x, y), min(x, y)) for x, y in ((h[start + i], h[start + j]) for i, j in pairs)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        place = frame[["key", "block", "turn"]].to_numpy()
        begins = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
        if len(begins) > 1:
            yield told(frame.iloc[: begins[-1]], begins[:-1])
        held = frame.iloc[begins[-1] :]
    if held is not None:
        yield told(held, np.zeros(1, np.int64))


def crossed(root: np.ndarray, sketch: np.ndarray, outside: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """The similar pairs of one pair of blocks: shingles are numbered, then each outside line's are marked and its partners' counted."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    numbers, found = np.unique(np.concatenate(sets), return_inverse=True)
    numbered = np.split(found, np.cumsum(sizes)[:-1])
    others, marked = np.flatnonzero(~outside), np.zeros(len(numbers), bool)
    n = sizes[others]
    for x in np.flatnonzero(outside):
        odd = sketch[others] ^ sketch[x]
        odd = np.bitwise_count((odd >> np.uint64(1) | odd) & np.uint64(0x5555555555555555))
        agreeing = (root[others] != root[x]) & (odd <= BANDS * ROWS - AGREE) & (np.minimum(n, sizes[x]) >= SIMILARITY * np.maximum(n, sizes[x]))
        marked[numbered[x]] = True
        for y in others[agreeing]:
            both = np.count_nonzero(marked[numbered[y]])
            if both >= SIMILARITY * (sizes[x] + sizes[y] - both):
                yield x, y
        marked[numbered[x]] = False


def crossing(lines: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of similar lines among those of ``apart``; a task holds one pair of blocks at once."""
    lines = written(lines, "apart")
    spark = base.sparkSession
    if lines.isEmpty():
        return lines.select(F.col("h").alias("a"), F.col("h").alias("b"))
    texts = texts_of(written(lines.select("h").distinct(), "wanted"), base)
    place = ["key", "block", "turn"]
    met = lines.withColumn("sketch", F.coalesce("sketch", F.lit(0))).join(texts, "h").repartition(*place).sortWithinPartitions(*place)
    with arrow_batches(spark, BLOCK):
        return written(met.mapInPandas(crosswise, "a long, b long").distinct(), "links")


def links(lines: DataFrame, base: DataFrame) -> DataFrame:
    """(a, b): pairs of similar lines that connect all lines of a component."""
    keyed_lines = lines.where("keys IS NOT NULL").select("h", F.get("keys", F.lit(BANDS)).alias("sketch"), F.explode(F.slice("keys", 1, BANDS)).alias("key"))
    met = rest = crowded(keyed_lines)
    tried = None
    for _ in range(STARS):
        star = written(starred(rest), "stars")
        alike = star.where(agree("sketch", "first_sketch")).select(F.col("h").alias("a"), F.col("first").alias("b"))
        tried = alike if tried is None else tried.union(alike)
        rest = star.where(~agree("sketch", "first_sketch")).select("key", "h", "sketch")
    tried = written(tried.distinct(), "pairs")
    linked = verified(tried, base)
    return linked.union(crossing(apart(met, linked), base))


def stays_of(base: DataFrame) -> DataFrame:
    """(h, stays: place) of lines that stand several times or are similar to others."""
    place = F.struct("k1", "k2", "pos")
    lines = written(
        exploded(base).select("h", place.alias("place"), band_keys("line").alias("keys"))  # no keys below SHINGLE characters
        .groupBy("h").agg(F.min("place").alias("place"), F.count("*").alias("copies"), F.first("keys").alias("keys")),
        "lines",
    )
    roots = components(links(lines, base)).select(F.col("node").alias("h"), "root")
    grouped = lines.select("h", "place", "copies").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    first = grouped.groupBy("root").agg(F.min("place").alias("stays"), F.sum("copies").alias("rows"))
    return grouped.select("h", "root").join(first.where("rows > 1").select("root", "stays"), "root").select("h", "stays")


def drops(docs: DataFrame) -> DataFrame:
    """(k1, k2, dropped: positions) of documents that lose lines."""
    base = keyed(docs)
    path = f"{work_folder(docs.sparkSession)}/{SCRATCH.get()}stays-{uuid.uuid4().hex}"
    with scratch(docs.sparkSession), lean_shuffles(docs.sparkSession):
        told = stays_of(base)
        told.write.parquet(path)
    told = docs.sparkSession.read.schema(told.schema).parquet(path)
    place = F.struct("k1", "k2", "pos")
    goes = exploded(base).select("h", place.alias("place")).join(told, "h").where("place <> stays")
    return goes.groupBy("place.k1", "place.k2").agg(F.sort_array(F.collect_set("place.pos")).alias("dropped"))


def judged(docs: DataFrame) -> DataFrame:
    """row (all of docs' columns), lines, dropped positions (null: none) and the text that stays."""
    met = keyed(docs).join(drops(docs), ["k1", "k2"], "left")
    lines = F.split("text", "\n")
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda i: F.get(x, i)), "\n"))
    stays = F.when(F.col("dropped").isNotNull(), kept).otherwise(F.col("row.text"))
    return met.select("row", F.size(lines).cast("long").alias("n_lines"), "dropped", stays.alias("stays"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_lines, n_dropped, the sha256 of the text that stays and whether all of it went."""
    return judged(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("stays", F.lit("")), 256).alias("kept_sha256"),
        (F.col("dropped").isNotNull() & (F.btrim("stays", F.lit(BLANKS)) == "")).alias("emptied"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; documents left without text go."""
    rows = judged(docs).where(F.col("dropped").isNull() | (F.btrim("stays", F.lit(BLANKS)) != ""))
    changed = {"text": F.col("stays")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("dropped").isNull(), F.col("row.n_chars")).otherwise(F.char_length("stays").cast("long"))
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
