"""Document fingerprints by winnowing, in DataFrame functions only.

A text loses its white space and is lower-cased (a final sigma as any other), character by character, so
that a joined text is spelled as its parts are. The hash of every ``GRAM`` neighbouring code points is rolled
up from its neighbours: pairs from single code points, fours from pairs, and so on, as a polynomial modulo a
prime, mixed at the end. Fewer characters make one gram of all of them. Every window of ``WINDOW`` neighbouring
grams (or all, if there are fewer) gives its smallest hash, the rightmost of equal ones, with its position among
the characters that are left. Any run of ``GRAM + WINDOW - 1`` such characters shared by two texts therefore
leaves a shared hash, in any script and with or without white space. A selected gram is one long: 33 bits of
hash, then 31 bits that fall with the position, so that the minimum of a window is the rightmost of equal
hashes. An array has fewer elements than 31 bits count, so positions never begin again.

A text is fingerprinted once: windows inside the part that an edit leaves are the edited text's too, and only
windows that reach over the cut are selected anew. The next document's fingerprint comes from the row after.

Defined results: null and empty texts have an empty fingerprint, and two empty ones are alike (1.0);
rows that repeat (same id and text) are one document in the order of documents but keep their rows;
rows sharing an id are ordered by a hash of their text; null ids come first; a lone document is its
own next. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import written

GRAM = 5
WINDOW = 8
POSITION_BITS = 31
POSITIONS = (1 << POSITION_BITS) - 1
PRIME = (1 << 31) - 1
BASE = 1_000_003
KEY = ["has_id", "id", "hash"]  # the order of documents


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: a plain alias would be evaluated at each use inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spelling(text: Column) -> Column:
    """The text without white space, lower-cased character by character."""
    return F.replace(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit("ς"), F.lit("σ"))


def power(k: int) -> int:
    return pow(BASE, k, PRIME)


def joined(left: Column, right: Column, size: int) -> Column:
    """The rolled value of two neighbouring runs of characters, the right one of ``size`` characters."""
    return left * F.lit(power(size)).cast("long") % F.lit(PRIME).cast("long") + right


def grams(codes: Column, k: int) -> Column:
    """Rolled values of every k neighbouring code points; of all of them if there are fewer."""

    def widen(level: Column, width: int) -> Column:
        if width == k:
            return level
        reach = min(width, k - width)
        if reach == width:
            wider = lambda x, i: joined(x, F.get(level, i + width), width)
            return let(F.transform(level, wider), lambda v: widen(v, 2 * width))
        # what is left of k: single code points, one after the other
        wider = lambda x, i: joined(x, F.get(codes, i + width), 1)
        return let(F.transform(level, wider), lambda v: widen(v, width + 1))

    n = F.size(codes)
    return F.when(n >= k, F.slice(widen(codes, 1), F.lit(1), F.greatest(n - (k - 1), F.lit(0)))).when(
        n > 0, F.array(F.reduce(codes, F.lit(0).cast("long"), lambda whole, x: joined(whole, x, 1)))
    ).otherwise(F.array().cast("array<bigint>"))


def minima(values: Column, w: int) -> Column:
    """The minimum of each window of w neighbours, by minima of windows of doubling width."""

    def widen(level: Column, width: int) -> Column:
        if width == w:
            return level
        reach = min(width, w - width)
        return let(F.transform(level, lambda x, i: F.least(x, F.get(level, i + reach))), lambda wider: widen(wider, width + reach))

    return F.when(F.size(values) > w, F.slice(widen(values, 1), F.lit(1), F.greatest(F.size(values) - (w - 1), F.lit(0)))).when(
        F.size(values) > 0, F.array(F.array_min(values))
    ).otherwise(F.array().cast("array<bigint>"))


def selected(spelled_text: Column, k: int = GRAM, w: int = WINDOW, start: Column | None = None) -> Column:
    """The winnowed grams of a spelling as packed longs, in the order of their positions, which count from ``start``."""
    characters = F.when(spelled_text == "", F.array().cast("array<string>")).otherwise(F.split(spelled_text, ""))
    codes = F.transform(characters, lambda c: F.ascii(c).cast("long"))
    first = F.lit(0) if start is None else start

    def packed(values: Column) -> Column:
        mask = F.lit(~POSITIONS).cast("long")
        last = F.lit(POSITIONS).cast("long") - first
        return F.transform(values, lambda v, i: F.xxhash64(v).bitwiseAND(mask) + (last - i))

    return let(codes, lambda c: let(grams(c, k), lambda g: let(packed(g), lambda v: F.array_distinct(minima(v, w)))))


def hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, POSITION_BITS)


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, hash_of))


def position_of(packed: Column) -> Column:
    return F.lit(POSITIONS) - packed.bitwiseAND(F.lit(POSITIONS))


def spelled(packed: Column) -> Column:
    """hash@position of every selected gram."""
    return F.array_join(F.transform(packed, lambda v: F.concat(F.hex(hash_of(v)), F.lit("@"), position_of(v).cast("string"))), " ")


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    def of_shared(shared: Column) -> Column:
        union = F.size(one) + F.size(other) - shared
        return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)

    return let(F.size(F.array_intersect(one, other)), of_shared)


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id`` and the selected grams with their character positions."""
    text = spelling(F.coalesce(F.col("text"), F.lit("")))
    pairs = F.transform(selected(text, k, w), lambda v: F.struct(hash_of(v).alias("hash"), position_of(v).alias("position")))
    return docs.select("doc_id", pairs.alias("fingerprint"))


def runs(keys: DataFrame) -> DataFrame:
    """KEY and homes: for each key the run of neighbouring keys that it belongs to, and as guest the run before.

    A range shuffle of the narrow keys; only the first key of each run meets in a single task. The first
    key of all is the guest of the last run.
    """
    spark = keys.sparkSession
    count = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(keys.distinct().repartitionByRange(count, *KEY).withColumn("run", F.spark_partition_id()), "runs")
    firsts = ranged.groupBy("run").agg(F.min(F.struct(*KEY)).alias("first"))
    whole = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("run").over(Window.orderBy("run")), F.max("run").over(whole))
    firsts = firsts.select("first.*", before.alias("before"))
    home, guest = (F.struct(F.col(c).alias("run"), F.lit(g).alias("guest")) for c, g in (("run", False), ("before", True)))
    homes = F.when(F.col("before").isNull(), F.array(home)).otherwise(F.array(home, guest))
    return ranged.join(firsts, KEY, "left").select(*KEY, homes.alias("homes"))


def against_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and of the next document's text.

    The edited text has its last quarter replaced by the beginning of the next document. Repeated rows are
    combined before the first shuffle; the second brings neighbours together, each run with the
    first document of the next one, so that a row finds its next document beside it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", text.alias("text"), F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"),
    )
    single = base.groupBy(*KEY).agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    n = F.char_length("text")
    placed = single.join(runs(base.select(*KEY)), KEY).select("*", F.inline("homes")).drop("homes")
    spelt = placed.repartition("run").select(
        "*", spelling(F.col("text")).alias("spelled"),
        F.char_length(spelling(F.expr("substring(text, 1, char_length(text) - int(char_length(text) / 4))"))).alias("m"),
    )
    # Windows that begin at or after `start` reach over the cut at m; without one before it the whole text does.
    sure = F.col("m") >= GRAM + WINDOW - 1
    start = F.when(sure, F.col("m") - (GRAM + WINDOW - 2)).otherwise(F.lit(0))
    none = F.array().cast("array<bigint>")
    parts = spelt.select(
        "run", "guest", *KEY, "doc_id", "text", "copies", "m", start.alias("start"),
        F.expr("substring(spelled, 1, m)").alias("stays"), F.col("spelled"),
    ).select(
        "run", "guest", *KEY, "doc_id", "text", "copies", "m", "start",
        F.substring("stays", F.col("start") + 1, F.lit(GRAM + WINDOW)).alias("edge"),
        F.when(sure, selected(F.col("stays"))).otherwise(none).alias("before"),
        F.when(sure & (F.char_length("spelled") == F.col("m")), none).otherwise(
            selected(F.substring("spelled", F.col("start") + 1, F.char_length("spelled")), start=F.col("start"))
        ).alias("over"),
    )
    order = Window.partitionBy("run").orderBy("guest", *KEY)
    ahead = F.lead(F.struct("text", "before", "over")).over(order)
    rows = parts.select("*", ahead.alias("next")).where("NOT guest").select(
        "doc_id", "text", "copies", "m", "start", "edge", "before", "over",
        F.expr("concat(substring(text, 1, char_length(text) - int(char_length(text) / 4)), substring(next.text, 1, int(char_length(text) / 4)))").alias("edited"),
        F.concat("edge", spelling(F.expr("substring(next.text, 1, int(char_length(text) / 4))"))).alias("beyond"),
        F.col("next.before").alias("next_before"), F.col("next.over").alias("next_over"),
    )
    added = F.when(sure & (F.char_length("beyond") == F.char_length("edge")), none).otherwise(selected(F.col("beyond"), start=F.col("start")))
    both = lambda one, other: F.array_distinct(F.concat(one, other))
    shown = let(F.struct(both("before", "over").alias("own"), both(F.col("before"), added).alias("edited"), both("next_before", "next_over").alias("next")), lambda g: let(
        F.struct(hashes(g["own"]).alias("own"), hashes(g["edited"]).alias("edited"), hashes(g["next"]).alias("next")),
        lambda h: F.struct(
            spelled(g["own"]).alias("fingerprint"), spelled(g["edited"]).alias("edited_fingerprint"),
            likeness(h["own"], h["edited"]).alias("near_edited"), likeness(h["own"], h["next"]).alias("near_next"),
        ),
    ))
    told = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "copies", F.inline(F.array(shown)))
    return told.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
