"""Delimited text of any size as an all-text table with stable record identity.

One distributed pass over the lines settles encoding and quoting; the header line alone settles
delimiter and names. Files stay splittable, also where quoted cells contain line breaks.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.hashing import encoded, fingerprint, record_uid
from sluice.session import written
from sluice.sources.blocks import BLOCK, FILE, ROW, file_trees, quoted_records

DELIMITERS = (",", "\t", ";")  # fixed values; the first wins a tie
CORRUPT = "_corrupt"
UNUSED = "￾"  # a noncharacter: keeps an empty quoted cell apart from a missing one


class IntakeError(ValueError):
    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Layout:
    delimiter: str
    encoding: str
    columns: list[str]
    multi_line: bool
    bom: bool


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines; the text source keeps the bytes of a line as they are."""
    return spark.read.option("lineSep", "\n").text(path)


def detect_layout(spark: SparkSession, path: str) -> Layout:
    """Encoding, quoting, delimiter and column names, or a refusal."""
    lines = text_lines(spark, path)
    raw = F.col("value").cast("binary")
    utf8 = F.is_valid_utf8(F.col("value"))
    # Line breaks never occur inside a multi-byte character, so lines can be judged one by one.
    # GB18030 stays switched on, because the table is read lazily later.
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    strict = spark.conf.get("spark.sql.legacy.codingErrorAction")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    try:
        round_trip = F.encode(F.decode(raw, "GB18030"), "GB18030") == raw
        facts = lines.agg(
            F.count("*").alias("lines"),
            F.bool_and(utf8).alias("utf8"),
            F.bool_and(utf8 | round_trip).alias("gb18030"),
            F.bool_or(F.regexp_count("value", F.lit('"')) % 2 == 1).alias("open_quotes"),
        ).first()
    finally:
        spark.conf.set("spark.sql.legacy.codingErrorAction", strict)
    if facts["lines"] == 0:
        raise IntakeError("CSV_EMPTY")
    if not facts["utf8"] and not facts["gb18030"]:
        raise IntakeError("CSV_ENCODING_UNSUPPORTED")
    encoding = "utf-8" if facts["utf8"] else "GB18030"
    first = lines.select(raw.alias("raw")).first()["raw"]
    header = bytes(first).decode(encoding).removesuffix("\r")
    bom = header.startswith("﻿")
    header = header.removeprefix("﻿")
    delimiter = max(DELIMITERS, key=header.count)
    columns = next(csv.reader(io.StringIO(header), delimiter=delimiter), [])
    if not columns or any(not name.strip() for name in columns):
        raise IntakeError("CSV_HEADER_INVALID", header[:200])
    if len(set(columns)) != len(columns):
        raise IntakeError("CSV_DUPLICATE_COLUMNS", header[:200])
    return Layout(delimiter, encoding, columns, bool(facts["open_quotes"]), bom)


def read_delimited(spark: SparkSession, path: str, layout: Layout | None = None, *, divert: bool = False) -> DataFrame:
    """All-text rows in file order; malformed rows fail the load, or go to ``_corrupt`` when diverted."""
    layout = layout or detect_layout(spark, path)
    if len(layout.columns) == 1 and not layout.multi_line:
        return single_column(spark, path, layout)
    if layout.multi_line:
        rows = parsed_records(spark, path, layout, divert=divert).where((F.col(BLOCK) > 0) | (F.col(ROW) > 0))
        return rows.orderBy(FILE, BLOCK, ROW).drop(FILE, BLOCK, ROW)
    schema = cell_schema(layout, divert)
    reader = spark.read.options(**cell_options(layout, divert), header="true", enforceSchema=str(layout.bom).lower(), encoding=layout.encoding)
    return reader.schema(schema).csv(path)


def cell_schema(layout: Layout, divert: bool) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in [*layout.columns, *[CORRUPT] * divert]])


def cell_options(layout: Layout, divert: bool) -> dict[str, str]:
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} if divert else {"mode": "FAILFAST"}
    return mode | {
        "sep": layout.delimiter, "quote": '"', "escape": '"', "nullValue": UNUSED, "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }


def parsed_records(spark: SparkSession, path: str, layout: Layout, *, divert: bool = False) -> DataFrame:
    """Cells of records with quoted line breaks, with file, block and row, headers included and compared with the layout."""
    records = quoted_records(spark, path, layout.encoding)
    schema = cell_schema(layout, divert)
    cells = F.from_csv("text", ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields), cell_options(layout, divert))
    parsed = records.select(FILE, BLOCK, ROW, cells.alias("__cells"))
    given = F.array(*[F.col("__cells")[name] for name in layout.columns])
    header = (F.col(BLOCK) == 0) & (F.col(ROW) == 0)
    other = header & ~given.eqNullSafe(F.array(*map(F.lit, layout.columns)))
    first = F.when(other, F.raise_error(F.concat(F.lit("CSV_HEADER_MISMATCH: "), FILE))).otherwise(F.col(ROW))
    return parsed.select(FILE, BLOCK, first.alias(ROW), *[F.col("__cells")[f.name].alias(f.name) for f in schema.fields])


def single_column(spark: SparkSession, path: str, layout: Layout, name: str | None = None) -> DataFrame:
    """One column, with its ordinals as ``name``: a line of blanks is a record here, which the CSV source would skip."""
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), layout.encoding), r"\r\z", "")
    lines = located(text_lines(spark, path)).withColumn("value", line)
    numbered = with_ordinal(lines, name or ROW, headers=True)
    quoted = F.regexp_extract("value", r'^"(.*)"\z', 1)
    cell = F.when(F.col("value").startswith('"'), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(F.col("value"))
    return numbered.select(*[name] * bool(name), cell.alias(layout.columns[0]))


def located(scan: DataFrame) -> DataFrame:
    """The rows of a file scan with their file, the block of the file and a number that rises along the block."""
    place = scan.metadataColumn("_metadata")
    return scan.select(
        place["file_path"].alias(FILE), place["file_block_start"].alias(BLOCK), F.monotonically_increasing_id().alias(ROW),
        *[F.col(f"`{c}`") for c in scan.columns],
    )


def with_ordinal(rows: DataFrame, name: str = "ordinal", *, headers: bool = False) -> DataFrame:
    """0-based position of each ``located`` row by file path, block and place in the block; ``headers`` leaves out each file's first row.

    The rows are written once, so counting and numbering see the same blocks however a scan is split.
    Offsets are running totals over one row per block.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in (FILE, BLOCK, ROW)]
    rows = written(rows, "located")
    skipped = F.when(F.col(BLOCK) == 0, 1).otherwise(0) if headers else F.lit(0)
    blocks = rows.groupBy(FILE, BLOCK).agg(F.count("*").alias("__n"), F.min(ROW).alias("__low"))
    before = Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("__n") - skipped).over(before), F.lit(0))
    offsets = written(blocks.select(FILE, BLOCK, "__low", offset.alias("__offset")), "blocks")
    position = F.col(ROW) - F.col("__low") - skipped
    return rows.join(offsets, [FILE, BLOCK]).where(position >= 0).select((F.col("__offset") + position).alias(name), *columns)


def intake(spark: SparkSession, path: str, dataset_hash: str | None = None, *, seal: str = "tree") -> tuple[DataFrame, Layout, str]:
    """Read, number, identify and write a delimited source once; everything else reads the result.

    ``seal`` says what identity means, whatever the source's size: "tree" is the hash tree of the files'
    bytes, "content" hashes the numbered cells, "bytes" whole files, each as one value (2 GiB at most).
    """
    layout = detect_layout(spark, path)
    if len(layout.columns) == 1 and not layout.multi_line:
        numbered = single_column(spark, path, layout, "ordinal")
    elif layout.multi_line:
        numbered = with_ordinal(parsed_records(spark, path, layout), headers=True)
    else:
        numbered = with_ordinal(located(read_delimited(spark, path, layout)))
    seals = {"tree": lambda: tree_hash(spark, path), "content": lambda: content_hash(numbered, layout.columns), "bytes": lambda: file_set_hash(spark, path)}
    digest = dataset_hash or seals[seal]()
    identified = numbered.select("ordinal", record_uid(digest, F.col("ordinal")).alias("record_uid"), *[F.col(f"`{c}`") for c in layout.columns])
    table = written(identified, "intake")
    if table.isEmpty():
        raise IntakeError("CSV_NO_RECORDS")
    return table, layout, digest


def content_hash(numbered: DataFrame, columns: list[str]) -> str:
    """Identity of the column names and of every row at its ordinal: constant state, the same for any split."""
    digests = numbered.select(F.sha2(F.concat_ws("|", F.col("ordinal").cast("string"), encoded(columns)), 256).alias("digest"))
    sealed = fingerprint(digests, "digest").first()
    return hashlib.sha256(json.dumps([columns, sealed["fingerprint"] if sealed else ""]).encode()).hexdigest()


def tree_hash(spark: SparkSession, path: str, **shape: int) -> str:
    """Identity of the source's bytes: the root of a single file's tree, or the fingerprint of the roots of several."""
    trees = written(file_trees(spark, path, **shape), "trees")
    if trees.count() == 1:
        return trees.first()["root"]
    return fingerprint(trees, "root").first()["fingerprint"]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def file_set_hash(spark: SparkSession, path: str) -> str:
    """Identity of the source's bytes: sha256 of a single file, or of the sorted file hashes, at any size."""
    hashes = sorted(row["sha256"] for row in file_hashes(spark, path).select("sha256").collect())
    return hashes[0] if len(hashes) == 1 else hashlib.sha256("\n".join(hashes).encode()).hexdigest()
