"""strptime formats on top of Spark's date functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directive -> (lenient parse letters, fixed-width print letters).
DIRECTIVES = {
    "%Y": ("yyyy", "yyyy"),
    "%y": ("yy", "yy"),
    "%m": ("M", "MM"),
    "%d": ("d", "dd"),
    "%H": ("H", "HH"),
    "%I": ("h", "hh"),
    "%M": ("m", "mm"),
    "%S": ("s", "ss"),
    "%f": ("SSSSSS", "SSSSSS"),
    "%p": ("a", "a"),
    "%b": ("MMM", "MMM"),
    "%B": ("MMMM", "MMMM"),
    "%z": ("XX", "XX"),
    "%T": ("H:m:s", "HH:mm:ss"),
    "%R": ("H:m", "HH:mm"),
}
TIME_DIRECTIVES = ("%H", "%M", "%S", "%f", "%I", "%p", "%z", "%Z", "%T", "%R")
DEFAULT_DATE_FORMAT = "%Y-%m-%d"
DEFAULT_DATETIME_FORMAT = "%Y-%m-%dT%H:%M:%S"


def has_time(fmt: str) -> bool:
    return any(directive in fmt for directive in TIME_DIRECTIVES)


def spark_format(fmt: str, *, parsing: bool) -> str | None:
    """Spark's spelling of a strptime format, or None when a directive has no counterpart.

    Parsing accepts one or two digits per field, except where fields touch each other.
    """
    pieces = re.findall(r"%.|[^%]+", fmt)
    out: list[str] = []
    for position, piece in enumerate(pieces):
        if not piece.startswith("%"):
            quoted = piece.replace("'", "''")
            out.append(f"'{quoted}'" if re.search("[A-Za-z']", piece) else piece)
            continue
        if piece not in DIRECTIVES:
            return None
        neighbours = pieces[max(position - 1, 0):position] + pieces[position + 1:position + 2]
        touching = any(other.startswith("%") for other in neighbours)
        out.append(DIRECTIVES[piece][0 if parsing and not touching else 1])
    return "".join(out)


def has_marks(value: Column, fmt: str) -> Column:
    """Does the cell hold the format's separators? Only then is it worth a parse, whose refusal costs far more."""
    marks = dict.fromkeys(mark for piece in re.findall(r"%.|[^%]+", fmt) if not piece.startswith("%") for mark in piece if mark in "-/.:, ")
    return reduce(lambda a, b: a & b, [F.contains(value, F.lit(mark)) for mark in marks], value.isNotNull())


def parse_date(value: Column, fmt: str) -> Column:
    pattern = spark_format(fmt, parsing=True)
    return F.lit(None).cast("date") if pattern is None else F.when(has_marks(value, fmt), F.try_to_date(value, pattern))


def parse_datetime(value: Column, fmt: str) -> Column:
    pattern = spark_format(fmt, parsing=True)
    if pattern is None:
        return F.lit(None).cast("timestamp")
    return F.when(has_marks(value, fmt), F.try_to_timestamp(value, F.lit(pattern)))


def plainly_parses(value: Column, fmt: str) -> Column:
    """Is the cell a date of the format that every calendar has? Told by its digits alone, where the format has just year, month and day."""
    pieces = re.findall(r"%.|[^%]+", fmt)
    if sorted(pieces[::2]) != ["%Y", "%d", "%m"] or not all(p in ("-", "/", ".") for p in pieces[1::2]):
        return F.lit(False)
    digits = {"%Y": "[1-9][0-9]{3}", "%m": "(?:0[1-9]|1[0-2])", "%d": "(?:0[1-9]|1[0-9]|2[0-8])"}
    return value.rlike("^" + "".join(digits.get(piece, re.escape(piece)) for piece in pieces) + r"\z")


def parses(value: Column, fmt: str, *, datetime: bool) -> Column:
    parsed = parse_datetime(value, fmt) if datetime else parse_date(value, fmt)
    return F.coalesce(plainly_parses(value, fmt), F.lit(False)) | parsed.isNotNull()


def reformat(value: Column, source: str, target: str) -> Column:
    """Rewrite a date from one format to another; a value that does not parse is kept."""
    printed = spark_format(target, parsing=False)
    if printed is None:
        return value
    timed = has_time(source) or has_time(target)
    parsed = parse_datetime(value, source) if timed else parse_date(value, source)
    return F.coalesce(F.date_format(parsed, printed), value)


def label_to_format(label: str) -> str | None:
    """strptime format for a shape label such as ``DD/MM/YYYY HH:MM:SS``; None without a year."""
    if "YYYY" not in label:
        return None
    date_part, hour, time_part = label.partition("HH")
    for token, directive in (("YYYY", "%Y"), ("DD", "%d"), ("MM", "%m"), ("SS", "%S")):
        date_part = date_part.replace(token, directive)
    for token, directive in (("YYYY", "%Y"), ("DD", "%d"), ("MM", "%M"), ("SS", "%S"), ("HH", "%H")):
        time_part = time_part.replace(token, directive)
    return date_part + ("%H" if hour else "") + time_part
