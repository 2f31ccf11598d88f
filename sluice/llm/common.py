"""Reading, byte-level words and connected components shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import written

REMEMBERED = 400_000  # results kept in a worker's memory
REMEMBERED_CHARS = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Bytes that stand in a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased; all others become spaces.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


class Remembered(dict):
    """Results of ``make`` by key, emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The column's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary")


def plain_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words of ASCII digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b: long) with the smallest node it is connected to.

    Alternating large-star and small-star steps: every node hands its larger, then its smaller,
    neighbours to the smallest one it knows. Rows never exceed the edges; the minimum per node is
    an aggregation and it goes back to the edges by a join that can split hot keys, so no
    neighbourhood is ever gathered. Each round is written to the shared folder, and the rounds end
    when a round leaves the edges as they were.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        if small:
            turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        else:
            turned = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = turned.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = turned.join(least, "a")
        if small:
            # a keeps the link to its minimum, the other smaller neighbours go to the minimum
            out = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def seal(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = seal(edges)
    while before[0]:
        edges = written(star(star(edges, False), True), "edges")
        after = seal(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
