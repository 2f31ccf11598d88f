"""Jaccard self-join of documents on word n-grams by signature trees.

Texts are lower-cased in A-Z and cut at ASCII white space; a document's set is its distinct 5-word
shingles (64-bit hashes), or its whole word sequence if it has fewer words. Two documents link when
5 * intersection >= 4 * union. The join is exact but for hash collisions:

1. One pass takes every document's set size and class (equal sets are one class) and counts shingles
   in a fixed number of cells; their levels are broadcast (0.5 MB) and order shingles from rare to frequent.
2. Linked sets share one of their first floor(n / 5) + 1 shingles in that order, so classes meet in
   the buckets of these. Every class is first held against its bucket's smallest member and against the two
   before it; near copies become one component by that, without a pair for every two of them. A bucket falls
   into runs where a size exceeds the one before by more than a quarter; runs of three are done with.
3. Longer runs that still hold several components get a signature tree: leaves of some 32 classes of like size
   with the OR of their token bitmaps, the range of their sizes and their largest number of colliding
   tokens; above them one node per bucket and size level. Pairs of nodes are walked from the top, and a pair is
   left out when its largest possible overlap (common bits, plus the fewer colliding tokens) can't
   reach 4/9 of the smallest sizes together; what remains goes down to leaves and then to classes.
4. Pairs that pass their own bitmaps' bound are verified on their whole texts.

Defined results: null texts and texts without words have an empty set and link with nothing; rows that
repeat (same id and text) are one document and keep their rows alike; different rows with one id are
compared like any others; a null id counts as the smallest in ordering, and component_id is the
smallest id that isn't null. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import components, plain_words
from sluice.llm.lines import keyed
from sluice.session import arrow_batches, written

WORDS = 5
CELL_BITS = 18
STEPS = 64  # levels of a cell's count per doubling: a frequent shingle stands out of a well filled cell
LEVEL_BITS = 12
LEAF = 32
BATCH_ROWS = 500  # texts, pairs or leaves (each with LEAF bitmaps) that a Python worker holds at once
LEVEL = 1.26  # sizes of linked sets differ by 1.25 at most, so their levels by 1
# Odd multipliers of the words of a shingle, and of the mixing steps.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = plain_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(n, WORDS)
    total = np.full(n - k + 1, k, np.uint64) * MIX
    for i in range(k):
        total += hashes[i : n - k + 1 + i] * FACTORS[i]
    total ^= total >> np.uint64(31)
    total *= MIX
    total ^= total >> np.uint64(29)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def level_of(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(LEVEL)))


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit per token at five to ten bits a token; sets of one level have one width."""
    width = max(64, 1 << int(np.ceil(np.log2(4 * LEVEL ** (level_of(len(hashes)) + 1)))))
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) at a smaller width: halves laid over each other."""
    while maps.shape[-1] > width:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


def ones(maps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps).sum(-1, dtype=np.int64)


def may_link(maps_a: np.ndarray, maps_b: np.ndarray, loose_a: np.ndarray, loose_b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether common bits and colliding tokens can reach 4/9 of ``least``, the smallest sizes' sum."""
    return 9 * (ones(maps_a & maps_b) + np.minimum(loose_a, loose_b)) >= 4 * least


def as_rows(maps: list[bytes], width: int) -> np.ndarray:
    return np.stack([folded(np.frombuffer(m, np.uint8), width) for m in maps])


def first_pass(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, doc_id, n, class) of every document, and (cell, tokens) of the shingle counts."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            sizes, names_of, met = [], [], []
            for text in batch.pop("text"):
                found = shingle_set(text)
                sizes.append(len(found))
                names_of.append(xxhash.xxh64_intdigest(found.tobytes()))
                met.append((found >> np.uint64(64 - CELL_BITS)).astype(np.int32))
                if sum(map(len, met[-64:])) > 1 << CELL_BITS or len(met) >= 2048:  # count many texts at once
                    cells += np.bincount(np.concatenate(met), minlength=len(cells))
                    met = []
            if met:
                cells += np.bincount(np.concatenate(met), minlength=len(cells))
            batch["n"], batch["class"] = np.array(sizes, np.int64), np.array(names_of, np.uint64).astype(np.int64)
            yield batch.reindex(columns=names).astype({"doc_id": "Int64", "cell": "Int64", "tokens": "Int64"})
        full = np.nonzero(cells)[0]
        yield pd.DataFrame({"cell": full, "tokens": cells[full]}).reindex(columns=names).astype({c: "Int64" for c in names})

    names = ["k1", "k2", "doc_id", "n", "class", "cell", "tokens"]
    read = keyed(docs).select("k1", "k2", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = written(read.mapInPandas(walk, ", ".join(f"{c} long" for c in names)), "sets")
    counts = out.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("tokens").alias("tokens"))
    return out.where("cell IS NULL").drop("cell", "tokens"), counts


def rare_first(counts: DataFrame) -> np.ndarray:
    """Per cell the level of its count, in steps of a 64th of a doubling: at most 2^CELL_BITS small numbers."""
    rows = counts.toPandas()
    levels = np.zeros(1 << CELL_BITS, np.uint16)
    levels[rows["cell"].to_numpy(np.int64)] = np.ceil(STEPS * np.log2(rows["tokens"].to_numpy(float) + 1)).astype(np.uint16)
    return levels


def classes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """One row per class: class, n, key and id of its first document, prefix tokens and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("n long, class long, prefix array<long>, bitmap binary")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found = shingle_set(text)
                n = len(found)
                level = shared.value[found >> np.uint64(64 - CELL_BITS)].astype(np.uint64)
                rank = (level << np.uint64(64 - LEVEL_BITS)) | (found >> np.uint64(LEVEL_BITS))
                first = np.argsort(rank)[: n // 5 + 1]
                name = np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64)
                rows.append((n, name, found[first].astype(np.int64), bitmap(found) if n else b""))
            yield pd.DataFrame(rows, columns=["n", "class", "prefix", "bitmap"])

    read = keyed(docs).select(F.struct("k1", "k2").alias("key"), F.col("row.doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = read.select("key", "doc_id", signed("text").alias("s")).where("s.n > 0")
    return written(
        rows.groupBy(F.col("s.class").alias("class"), F.col("s.n").alias("n")).agg(
            F.min("key").alias("key"), F.min("doc_id").alias("doc_id"), F.first("s.prefix").alias("prefix"), F.first("s.bitmap").alias("bitmap")
        ),
        "classes",
    )


def fits() -> str:
    return "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"


def met_in_buckets(sets: DataFrame) -> DataFrame:
    """(token, class, n, first, before, second, run) of the classes that share a prefix token with another.

    Runs are numbered along the sizes of a bucket; a size that is too far from the one before begins the next.
    """
    rows = sets.select("class", "n", F.explode("prefix").alias("token"))
    ordered = Window.partitionBy("token").orderBy("n", "class")
    whole = Window.partitionBy("token")
    one = F.struct("class", "n")
    apart = F.when(F.col("before").isNull() | (4 * F.col("n") > 5 * F.col("before.n")), 1).otherwise(0)
    met = rows.select(
        "token", "class", "n", F.count("*").over(whole).alias("count"),
        F.first(one).over(ordered).alias("first"), F.lag(one).over(ordered).alias("before"), F.lag(one, 2).over(ordered).alias("second"),
    )
    return written(met.withColumn("run", F.sum(apart).over(ordered)).where("count > 1").drop("count"), "buckets")


def star_pairs(buckets: DataFrame) -> DataFrame:
    pairs = buckets.where("before IS NOT NULL").select("class", "n", F.explode(F.array("first", "before", "second")).alias("o")).where("o IS NOT NULL")
    return pairs.select(F.col("class").alias("a"), F.col("o.class").alias("b"), F.col("n").alias("n_a"), F.col("o.n").alias("n_b")).where(fits()).distinct()


def trees(buckets: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of classes of different components that the dual traversal leaves."""
    rows = buckets.select(F.xxhash64("token", "run").alias("token"), "class", "n").join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    rows = written(rows.withColumn("root", F.coalesce("root", "class")), "trees")
    # Buckets of several components; of those with the same members, one.
    several = rows.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count"),
        F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"),
    ).where("low <> high AND count > 3").groupBy("count", "x", "y").agg(F.min("token").alias("token"))
    level = F.floor(F.log("n") / F.log(F.lit(LEVEL))).cast("int")
    member = rows.join(several.select("token", "count"), "token").join(sets.select("class", "bitmap"), "class").withColumn("level", level)
    leaf = F.pmod(F.xxhash64("class"), F.ceil(F.col("count") / LEAF)).cast("int")

    def bounds(maps: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int, int]:
        maps = folded(maps, max(maps.shape[1] // 4, 4))  # nodes are bounded at a quarter of the width
        half = folded(maps, max(maps.shape[1] // 2, 4))
        return np.bitwise_or.reduce(maps).tobytes(), int((sizes - ones(maps)).max()), int((sizes - ones(half)).max())

    @F.pandas_udf("any binary, loose long, loose_half long, maps binary")
    def leaf_of(sizes: pd.Series, bitmaps: pd.Series) -> pd.DataFrame:
        """What bounds a leaf's members. Level and width go together but for rounding: take the smaller width."""
        rows = []
        for n, each in zip(sizes, bitmaps):
            maps = as_rows(list(each), min(map(len, each)))
            rows.append((*bounds(maps, np.asarray(n)), maps.tobytes()))
        return pd.DataFrame(rows, columns=["any", "loose", "loose_half", "maps"])

    @F.pandas_udf(T.BinaryType())
    def united(bitmaps: pd.Series) -> pd.Series:
        return pd.Series([np.bitwise_or.reduce(as_rows(list(each), min(map(len, each)))).tobytes() for each in bitmaps], dtype=object)

    # A leaf has some LEAF members whatever the bucket's size, so collecting them is bounded.
    one = F.struct("class", "n", "root", "bitmap")
    leaves = member.withColumn("leaf", leaf).groupBy("token", "level", "leaf").agg(F.min("n").alias("least"), F.collect_list(one).alias("m"))
    leaves = leaves.withColumn("node", leaf_of("m.n", "m.bitmap"))
    leaves = written(
        leaves.select(
            "token", "level", "leaf", "least", "node.*", F.col("m.class").alias("classes"), F.col("m.n").alias("sizes"), F.col("m.root").alias("roots")
        ),
        "leaves",
    )
    tops = leaves.groupBy("token", "level").agg(
        F.min("least").alias("least"), F.collect_list("any").alias("any"), F.max("loose").alias("loose"), F.max("loose_half").alias("loose_half")
    ).withColumn("any", united("any"))

    @F.pandas_udf(T.BooleanType())
    def open_pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for x, y in zip(a.itertuples(), b.itertuples()):
            width = min(len(x.any), len(y.any))
            # At a folded width more tokens collide; half the width is the farthest two neighbouring levels are apart.
            loose = [r.loose if len(r.any) == width else r.loose_half for r in (x, y)]
            maps = as_rows([x.any, y.any], width)
            out.append(bool(may_link(maps[0], maps[1], loose[0], loose[1], x.least + y.least)))
        return pd.Series(out, dtype=bool)

    def paired(nodes: DataFrame, columns: list[str]) -> DataFrame:
        """Nodes of one bucket on the same or on neighbouring levels, the lower one as a."""
        left = nodes.select("token", "level", F.struct(*columns).alias("a"))
        right = nodes.select("token", F.explode(F.array("level", F.col("level") - 1)).alias("level"), F.col("level").alias("upper"), F.struct(*columns).alias("b"))
        return left.join(right, ["token", "level"])

    down = paired(tops, ["least", "any", "loose", "loose_half"]).where(open_pair("a", "b")).select("token", "level", "upper")
    below = paired(leaves, ["leaf", "least", "any", "loose", "loose_half"]).join(down, ["token", "level", "upper"])
    open_leaves = below.where("upper > level OR a.leaf <= b.leaf").where(open_pair("a", "b")).select(
        "token", "level", "upper", F.col("a.leaf").alias("leaf_a"), F.col("b.leaf").alias("leaf_b")
    )
    full = F.struct("classes", "sizes", "roots", "maps")
    left = open_leaves.join(
        leaves.select("token", "level", F.col("leaf").alias("leaf_a"), full.alias("a")), ["token", "level", "leaf_a"]
    ).join(leaves.select("token", F.col("level").alias("upper"), F.col("leaf").alias("leaf_b"), full.alias("b")), ["token", "upper", "leaf_b"])

    @F.pandas_udf("array<struct<a:long,b:long,n_a:long,n_b:long>>")
    def crossing(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for x, y in zip(a.itertuples(), b.itertuples()):
            maps = [np.frombuffer(r.maps, np.uint8).reshape(len(r.classes), -1) for r in (x, y)]
            width = min(m.shape[1] for m in maps)
            maps = [folded(m, width) for m in maps]
            n = [np.asarray(r.sizes) for r in (x, y)]
            loose = [size - ones(m) for size, m in zip(n, maps)]
            size_a, size_b = n[0][:, None], n[1][None, :]
            keep = may_link(maps[0][:, None, :], maps[1][None, :, :], loose[0][:, None], loose[1][None, :], size_a + size_b)
            keep &= np.asarray(x.roots)[:, None] != np.asarray(y.roots)[None, :]
            keep &= 5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)
            i, j = np.nonzero(keep)
            ca, cb = np.asarray(x.classes)[i], np.asarray(y.classes)[j]
            out.append([{"a": int(p), "b": int(q), "n_a": int(s), "n_b": int(t)} for p, q, s, t in zip(ca, cb, n[0][i], n[1][j])])
        return pd.Series(out, dtype=object)

    pairs = left.select(F.inline(crossing("a", "b")))
    swap = F.col("a") < F.col("b")
    return pairs.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.least("a", "b").alias("b"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    ).distinct()


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass their bitmaps' bound and then the comparison of their whole texts."""

    @F.pandas_udf(T.BooleanType())
    def bounded(map_a: pd.Series, map_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        out = []
        for x, y, p, q in zip(map_a, map_b, n_a, n_b):
            maps = as_rows([x, y], min(len(x), len(y)))
            out.append(bool(may_link(maps[0], maps[1], p - ones(maps[0]), q - ones(maps[1]), p + q)))
        return pd.Series(out, dtype=bool)

    @F.pandas_udf(T.BooleanType())
    def linked(text_a: pd.Series, text_b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(text_a, text_b):
            one, other = shingle_set(x), shingle_set(y)
            both = len(np.intersect1d(one, other, assume_unique=True))
            out.append(5 * both >= 4 * (len(one) + len(other) - both))
        return pd.Series(out, dtype=bool)

    maps = sets.select("class", "bitmap")
    near = pairs.join(maps.select(F.col("class").alias("a"), F.col("bitmap").alias("map_a")), "a").join(
        maps.select(F.col("class").alias("b"), F.col("bitmap").alias("map_b")), "b"
    )
    near = written(near.where(bounded("map_a", "map_b", "n_a", "n_b")).select("a", "b"), "pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(sets.select("class", "key"), "class").select("class", "key.k1", "key.k2")
    wanted = written(wanted, "wanted")
    base = keyed(docs).select("k1", "k2", F.col("text").cast("binary").alias("text"))
    texts = written(base.join(wanted, ["k1", "k2"]).groupBy("class").agg(F.first("text").alias("text")), "texts")
    both = near.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return both.where(linked("text_a", "text_b")).select("a", "b")


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (k1, k2, doc_id, n, class), and class with its component's first key and smallest id."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        rows, counts = first_pass(docs)
        sets = classes(docs, rare_first(counts))
        buckets = met_in_buckets(sets)
        links = written(verified(star_pairs(buckets), sets, docs), "links")
        roots = components(links)
        crossing = written(trees(buckets, sets, roots), "crossing")
        more = written(verified(crossing, sets, docs), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    placed = sets.select("class", "key", "doc_id").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    firsts = placed.groupBy("root").agg(F.min("key").alias("first"), F.min("doc_id").alias("component_id"))
    return rows, placed.select("class", "root").join(firsts, "root").select("class", "first", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_shingles and component_id; documents with an empty set are alone."""
    rows, found = joined(docs)
    empty = F.col("n") == 0
    alone = rows.where(empty).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where(~empty).join(found, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; empty ones all stay."""
    rows, found = joined(docs)
    others = rows.where("n > 0").join(found, "class").where("k1 <> first.k1 OR k2 <> first.k2").select("k1", "k2")
    stays = keyed(docs).join(others, ["k1", "k2"], "left_anti")
    return stays.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
