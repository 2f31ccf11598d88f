"""Source divergence audit: smoothed term shares of all (lang, source) groups compared within a language.

The group-term count matrix of a language is cut into stripes of ``SIDE`` terms and blocks of
``SIDE`` sources. A tile of it becomes a k-squared quadtree (k = 2): one bitmap per level, a bit per
quadrant that holds a count. Two tiles of one stripe are walked together from the root: where both
have an empty quadrant every term of it costs the same for a pair of groups, the distance of their
shares of an unseen term, so it is priced by its width; other quadrants are opened down to single
cells. Tiles are tasks of a Spark grouping; what they return per pair of sources is summed.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Shares are integers,
``1 + floor(10^9 (count + 5) / (N + 5 V))``, computed in decimals; everything is exact.

Defined results: null text, lang and source are the empty string; empty texts add nothing but their
group exists; a language without kept terms has value 0 for all its pairs; equal values rank by item
in UTF-8 order; rows that repeat all count; an empty table gives no rows; only text, lang and source
are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import utf8
from sluice.session import written

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
LEVELS = 6
LEAF = 4
SIDE = LEAF << LEVELS
HELD_ENTRIES = 600_000  # counts that a task holds before it hands them on
ONE_DOC = 1 << 40
FRONTIER = 1 << 15  # quadrant pairs that are opened at once

# Bytes of a term of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after A-Z is lower-cased; all others become spaces.
LETTER_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, a int, b int, value long, terms long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and term: occurrences and documents, added up as far as a task holds them."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences + ONE_DOC * documents
    fields = ("lang", "source", "term", "n", "docs")

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            both = np.fromiter(terms.values(), np.int64, len(terms))
            words = pa.array(list(terms), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), words, pa.array(both % ONE_DOC), pa.array(both // ONE_DOC)], fields)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(name).to_pylist() for name in ("lang", "source", "text"))):
            terms = held.setdefault((lang, source), {})
            have = terms.get
            for term, n in Counter(text.translate(LETTER_TABLE).split()).items():
                terms[term] = have(term, 0) + n + ONE_DOC
        if sum(map(len, held.values())) > HELD_ENTRIES:
            yield from flush()
    yield from flush()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)) in decimals."""
    top = (n + SMOOTHING).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + terms.cast("decimal(19,0)") * F.lit(SMOOTHING).cast("decimal(1,0)")
    return F.call_function("div", top, below) + F.lit(1).cast("long")


def quadtree(filled: np.ndarray) -> list[np.ndarray]:
    """Bitmaps from the root (one bit) to leaves of LEAF x LEAF cells: a bit says whether its quadrant holds a count."""
    levels = [filled.reshape(SIDE // LEAF, LEAF, SIDE // LEAF, LEAF).any(axis=(1, 3))]
    while len(levels[0]) > 1:
        half = len(levels[0]) // 2
        levels.insert(0, levels[0].reshape(half, 2, half, 2).any(axis=(1, 3)))
    return levels


def walk(a: np.ndarray, b: np.ndarray, floor_a: np.ndarray, floor_b: np.ndarray, width: int, same: bool) -> np.ndarray:
    """Sums over ``width`` terms of |share in a - share in b| for every row of tile ``a`` with every row of ``b``.

    ``a`` and ``b`` hold shares, 0 where nothing is counted; the floors are the shares of an unseen term, -1 for
    rows that don't exist, which come last. With ``same`` only pairs of a row with itself or a later one are walked.
    """
    left, right = quadtree(a > 0), quadtree(b > 0)
    rows_a, rows_b = (int((f >= 0).sum()) for f in (floor_a, floor_b))
    full = []
    for tile, floor in ((a, floor_a), (b, floor_b)):
        shares = np.where(tile > 0, tile, floor[:, None])
        shares[:, width:] = 0
        full.append(shares.reshape(SIDE // LEAF, LEAF, SIDE // LEAF, LEAF).transpose(0, 2, 1, 3))
    side = SIDE // LEAF
    total = np.zeros((side, side, LEAF, LEAF), np.int64)
    empty = [np.zeros((1 << level, 1 << level), np.int64) for level in range(LEVELS + 1)]
    waiting = [(0, *(np.zeros(1, np.int64) for _ in range(3)))]
    steps = [np.array(s) for s in zip(*((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)))]
    while waiting:
        level, x, y, c = waiting.pop()
        if len(x) > FRONTIER:
            waiting += [(level, *(v[i : i + FRONTIER] for v in (x, y, c))) for i in range(0, len(x), FRONTIER)]
            continue
        some = left[level][x, c] | right[level][y, c]
        size = SIDE >> level
        none = ~some
        np.add.at(empty[level], (x[none], y[none]), np.clip(width - c[none] * size, 0, size))
        x, y, c = x[some], y[some], c[some]
        if not len(x):
            continue
        if level == LEVELS:
            turn = np.argsort(x * side + y, kind="stable")
            x, y, c = x[turn], y[turn], c[turn]
            cost = np.abs(full[0][x, c][:, :, None, :] - full[1][y, c][:, None, :, :]).sum(axis=-1)
            first = np.flatnonzero(np.diff(x * side + y, prepend=-1))
            total[x[first], y[first]] += np.add.reduceat(cost, first, axis=0)
        else:
            x, y, c = ((2 * v[:, None] + s).ravel() for v, s in zip((x, y, c), steps))
            half = size // 2
            open_ = (x * half < rows_a) & (y * half < rows_b) & (c * half < width)
            if same:
                open_ &= x <= y
            waiting.append((level + 1, x[open_], y[open_], c[open_]))
    terms = sum(np.repeat(np.repeat(e, SIDE >> level, 0), SIDE >> level, 1) for level, e in enumerate(empty))
    cells = total.transpose(0, 2, 1, 3).reshape(SIDE, SIDE)
    return cells + terms * np.abs(floor_a[:, None] - floor_b[None, :])


def tile_pair(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """The sums of one stripe for all pairs of a source of block ``one`` with a source of block ``two``."""
    lang, _, one, two = key
    rows, cols, shares = (cells[name].to_numpy() for name in ("row", "col", "p"))
    width = int(cells["width"].iloc[0])
    tiles, floors = [], []
    for block in (one, two):
        own = rows // SIDE == block
        tile, floor = np.zeros((SIDE, SIDE), np.int64), np.full(SIDE, -1, np.int64)
        unseen = own & (cols < 0)
        floor[rows[unseen] % SIDE] = shares[unseen]
        seen = own & (cols >= 0)
        tile[rows[seen] % SIDE, cols[seen]] = shares[seen]
        tiles.append(tile)
        floors.append(floor)
    sums = walk(*tiles, *floors, width, one == two)
    here = (floors[0] >= 0)[:, None] & (floors[1] >= 0)[None, :]
    a, b = np.nonzero(here & np.triu(np.ones_like(here), 1) if one == two else here)
    return pd.DataFrame({"lang": lang, "a": a + one * SIDE, "b": b + two * SIDE, "value": sums[a, b], "terms": width})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every group against the other sources and the terms it has above its language."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), utf8().alias("text"))
    partial = texts.mapInArrow(count_terms, COUNTS)
    counts = written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")

    # Kept terms numbered by partition and place; a stripe is SIDE neighbours of one language.
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= min_docs)
    placed = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("place", F.monotonically_increasing_id())
    terms = written(
        placed.select("lang", "term", "lang_n", F.expr(f"place div {SIDE}").alias("stripe"), (F.col("place") % SIDE).cast("int").alias("col")),
        "kept-terms",
    )
    # A stripe may hold the last terms of one language and the first of the next: each counts from its own first place.
    stripes = terms.groupBy("lang", "stripe").agg(F.min("col").alias("first"), F.count("*").alias("width"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))

    cells = counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "stripe", "col", "n", "lang_n")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = texts.select("lang", "source").distinct()
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = written(
        every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        .withColumn("row", F.row_number().over(by_source) - 1)
        .withColumn("unseen", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0))),
        "groups",
    )
    priced = written(
        cells.join(groups, ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
        .withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
        .select("lang", "source", "term", "stripe", "col", "row", "p", "q"),
        "priced-cells",
    )

    blocks = groups.groupBy("lang").agg((F.floor(F.max("row") / SIDE) + 1).cast("int").alias("blocks"))
    seen = priced.join(stripes, ["lang", "stripe"]).select("lang", "stripe", "row", (F.col("col") - F.col("first")).alias("col"), "p", "width")
    floors = stripes.join(groups, "lang").select("lang", "stripe", "row", F.lit(-1).alias("col"), F.col("unseen").alias("p"), "width")
    block = F.floor(F.col("row") / SIDE).cast("int")
    tiles = (
        seen.union(floors).join(blocks, "lang")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", "stripe", "row", "col", "p", "width", F.least(block, "other").alias("one"), F.greatest(block, "other").alias("two"))
    )
    sums = (
        tiles.groupBy("lang", "stripe", "one", "two").applyInPandas(tile_pair, PARTS)
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    both = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    first = groups.select("lang", "source", F.col("row").alias("a"))
    second = groups.select("lang", F.col("source").alias("item"), F.col("row").alias("b"))
    pairs = first.join(second, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    above = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).union(above.withColumn("rank", rank).where(F.col("rank") <= top_terms))
