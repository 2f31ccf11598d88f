"""Files of any size by blocks: one small row of facts per block lets every block be read on its own.

A scan of lines splits files into blocks. What a block can't know from its own lines, its first byte's
place in the file and whether it starts inside a quoted cell, follows from the facts of the blocks before
it by a running total. With these facts a task walks its blocks line by line: to hash byte ranges
(``file_trees``) or to put records with quoted line breaks together (``quoted_records``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import arrow_batches, written

FILE, BLOCK, ROW = "__file", "__block", "__row"
LEAF_BYTES = 1 << 20
FANOUT = 1024
BATCH_LINES = 500  # lines that a Python worker takes at once: a line of HTML may have some 10 KB
SENT_BLOCKS = 200_000  # facts of so many blocks (some 10 MB) may be sent to every task
BOM = b"\xef\xbb\xbf"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, value): the bytes of every line with its place; the source leaves out a byte order mark."""
    scan = spark.read.option("lineSep", "\n").text(path)
    place = scan.metadataColumn("_metadata")
    return scan.select(
        place["file_path"].alias(FILE), place["file_block_start"].alias(BLOCK), place["file_size"].alias("size"), F.col("value").cast("binary").alias("value")
    )


def block_facts(scan: DataFrame) -> DataFrame:
    """One row per block: id, first byte, whether the file has a byte order mark or no line break at its end,
    whether the block starts inside quotes, and the block whose last record it goes on with."""
    text = F.col("value").cast("string")
    odd = F.regexp_count(text, F.lit('"')) % 2 == 1
    own = scan.groupBy(FILE, BLOCK).agg(
        F.max("size").alias("size"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.count_if(odd).alias("odd"),
    )
    along = Window.partitionBy(FILE).orderBy(BLOCK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(FILE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differ = F.col("size") - F.sum("bytes").over(whole)  # 3 more with a mark, 1 less without the last line break
    facts = own.select(
        FILE, BLOCK, "size", "odd", differ.alias("differ"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"),
        (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.row_number().over(Window.partitionBy(FILE).orderBy(F.desc(BLOCK))) == 1).alias("last"),
    )
    ends_inside = F.when(F.col("inside"), F.col("odd") % 2 == 0).otherwise(F.col("odd") % 2 == 1)
    opens = ends_inside & (~F.col("inside") | (F.col("odd") > 0))
    opened = facts.withColumn("opens", opens).withColumn("owner", F.max(F.when(F.col("opens"), F.col(BLOCK))).over(before))
    marked = F.col("differ") >= 2
    return written(
        opened.select(
            F.monotonically_increasing_id().alias("id"), FILE, BLOCK, "size", "inside", "opens", "owner",
            (F.col("offset") + F.when(marked & (F.col(BLOCK) > 0), 3).otherwise(0)).alias("offset"),
            (marked & (F.col(BLOCK) == 0)).alias("bom"), (F.col("last") & F.col("differ").isin(-1, 2)).alias("cut"),
        ),
        "blocks",
    )


def in_order(scan: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """The lines with facts of their block, block by block in the order of the file."""
    narrow = facts.select(FILE, BLOCK, "id", *columns)
    if facts.count() <= SENT_BLOCKS:
        return scan.join(F.broadcast(narrow), [FILE, BLOCK]).select("id", *columns, "value")
    numbered = scan.withColumn(ROW, F.monotonically_increasing_id())
    return numbered.join(narrow.hint("merge"), [FILE, BLOCK]).sortWithinPartitions("id", ROW).select("id", *columns, "value")


def block_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """(block id, first row, rows) of neighbouring rows of one block."""
    ids = batch.column("id").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    for first, stop in zip(cuts, cuts[1:]):
        if stop > first:
            yield int(ids[first]), first, stop - first


# ---- trees of byte ranges

PIECES = "id long, leaf long, at long, digest string, raw binary"


def leaf_pieces(leaf_bytes: int):
    """Digests of the leaves that lie in one block; the bytes of leaves that reach over a block's border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, held, cut, rows = None, 0, bytearray(), False, []

        def flush(everything: bool) -> None:
            nonlocal at
            while held and (everything or at + len(held) >= (at // leaf_bytes + 1) * leaf_bytes):
                leaf = at // leaf_bytes
                part = bytes(held[: (leaf + 1) * leaf_bytes - at])
                whole = len(part) == leaf_bytes
                rows.append((block, leaf, at, hashlib.sha256(part).hexdigest() if whole else None, None if whole else part))
                at += len(part)
                del held[: len(part)]

        def finish() -> None:
            if cut and held:
                del held[-1]
            flush(True)

        def emit() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["id", "leaf", "at", "digest", "raw"])
            rows.clear()
            return out

        for batch in batches:
            for id_, first, n in block_runs(batch):
                if id_ != block:
                    finish()
                    block, at = id_, batch.column("offset")[first].as_py()
                    cut = batch.column("cut")[first].as_py()
                    held[:] = BOM if batch.column("bom")[first].as_py() else b""
                elif held or at:
                    flush(False)
                held += b"\n".join(batch.column("value").slice(first, n).to_pylist()) + b"\n"
                # The last line break may have to go, so a leaf that ends the text so far waits.
                if len(held) > 2 * leaf_bytes:
                    tail = held[-1:]
                    del held[-1]
                    flush(False)
                    held += tail
            if rows:
                yield emit()
        finish()
        if rows:
            yield emit()

    return run


def file_trees(spark: SparkSession, path: str, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(path, length, leaves, root): the hash tree of every file.

    A leaf is the sha256 of ``leaf_bytes`` neighbouring bytes, a node the sha256 of "node:" and the hex
    digests of up to ``fanout`` children; a file of one leaf has that leaf as its root. The result depends on the bytes
    alone, not on splits, and no file, only a leaf or a line, is ever one value. Empty files aren't listed.
    """
    listing = spark.read.format("binaryFile").load(path)
    listed = listing.select(listing.metadataColumn("_metadata")["file_path"].alias(FILE), "length")
    scan = lines(spark, path)
    facts = block_facts(scan)
    pieces = in_order(scan, facts, "offset", "bom", "cut").mapInArrow(leaf_pieces(leaf_bytes), PIECES)
    joined = F.reduce(F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("at", "raw")))), F.lit(b""), lambda a, x: F.concat(a, x["raw"]))
    nodes = (
        pieces.join(facts.select("id", FILE), "id").groupBy(FILE, F.col("leaf").alias("node"))
        .agg(F.coalesce(F.max("digest"), F.sha2(joined, 256)).alias("digest"))
    )
    with arrow_batches(spark, BATCH_LINES):
        nodes = written(nodes, "leaves")
    most = listed.agg(F.max("length")).first()[0] or 0
    levels, width = 0, -(-most // leaf_bytes)
    while width > 1:
        levels, width = levels + 1, -(-width // fanout)
    counts = listed.withColumn("leaves", F.ceil(F.col("length") / leaf_bytes).cast("long"))
    nodes = nodes.join(counts, FILE).withColumn("wide", F.col("leaves"))
    for _ in range(levels):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        above = F.sha2(F.concat(F.lit("node:"), F.array_join(F.transform(children, lambda c: c["digest"]), "")), 256)
        nodes = (
            nodes.groupBy(FILE, "length", "leaves", "wide", F.expr(f"node div {fanout}").alias("parent"))
            .agg(F.when(F.col("wide") == 1, F.max("digest")).otherwise(above).alias("digest"))
            .select(FILE, "length", "leaves", F.ceil(F.col("wide") / fanout).cast("long").alias("wide"), F.col("parent").alias("node"), "digest")
        )
    return nodes.select(F.col(FILE).alias("path"), "length", "leaves", F.col("digest").alias("root"))


# ---- records with quoted line breaks

RECORDS = "id long, row long, part long, text string"


def record_pieces(encoding: str):
    """Records that start in a block, put together line by line.

    ``part`` is -1 for a record that also ends in its block, else the part's place: 0 for the open end of the
    block that starts it, the block's id plus 1 for lines of later blocks (with the row unknown, null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, leading, row = None, False, False, 0
        open_: list[bytes] = []
        out: tuple[list, ...] = ([], [], [], [])

        def put(lines_: list[bytes], whole: bool) -> None:
            nonlocal row
            text = b"\n".join(lines_).decode(encoding)
            if leading:
                place = (None, block + 1, text)
            elif whole:
                text = text.removesuffix("\r")
                if not text:
                    return
                place = (row, -1, text)
            else:
                place = (row, 0, text)
            for column, value in zip(out, (block, *place)):
                column.append(value)
            row += not leading

        def finish() -> None:
            if open_:
                put(open_, False)
                open_.clear()

        def emit() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["id", "row", "part", "text"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for id_, first, n in block_runs(batch):
                if id_ != block:
                    finish()
                    block, row = id_, 0
                    inside = leading = batch.column("inside")[first].as_py()
                values = batch.column("value").slice(first, n)
                odd = pc.count_substring(values, b'"').to_numpy() % 2 == 1
                after = (np.cumsum(odd) + inside) % 2 == 1
                held = values.to_pylist()
                # Lines up to each one that leaves no quote open belong together.
                start = 0
                for end in np.flatnonzero(~after).tolist():
                    put([*open_, *held[start : end + 1]], True)
                    open_.clear()
                    leading, start = False, end + 1
                open_ += held[start:]
                inside = bool(after[-1])
            if out[0]:
                yield emit()
        finish()
        if out[0]:
            yield emit()

    return run


def quoted_records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(__file, __block, __row, text): the records of delimited files, split wherever a scan splits them.

    A record belongs to the block in which it starts and ``__row`` counts along the block; line breaks inside quotes are
    part of it. Empty lines between records are no records. A quote that is never closed makes the rest of its file one record.
    """
    scan = lines(spark, path)
    facts = block_facts(scan)
    with arrow_batches(spark, BATCH_LINES):
        pieces = written(in_order(scan, facts, "inside").mapInArrow(record_pieces(encoding), RECORDS), "records")
    whole = pieces.where("part = -1").join(facts.select("id", FILE, BLOCK), "id").select(FILE, BLOCK, F.col("row").alias(ROW), "text")
    parts = pieces.where("part >= 0").join(facts.select("id", FILE, BLOCK, "owner"), "id")
    owned = parts.withColumn("home", F.when(F.col("part") == 0, F.col(BLOCK)).otherwise(F.col("owner")))
    ordered = F.array_sort(F.collect_list(F.struct(BLOCK, "part", "text")))
    # A block's leading lines sort before its own open end, which is another record's home.
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
    stitched = owned.groupBy(FILE, "home").agg(F.max("row").alias(ROW), text.alias("text"))
    return whole.union(stitched.select(FILE, F.col("home").alias(BLOCK), ROW, F.regexp_replace("text", r"\r\z", "").alias("text")))
