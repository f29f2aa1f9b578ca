"""String predicates and clean-up used on log lines, delimited text and columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of decoration or comment that carry no record, as seen after blanks
# and quotes around the line are set aside.
JUNK_STARTS = (
    r"$",
    r"[=\-*.]{3}",
    r'#+(?!\s*"*\s*$)\s',
    r'\[.*\]\s*"*\s*$',
    r"(?i:log\s+file)",
)
JUNK_ARROW, JUNK_BANNER = "==>", r"==>[^,]*,.*,<=="

# Text that shows a quoted line is a log record wrapped by a spreadsheet.
WRAPPED_RECORD_MARKERS = (",-,-,", "HTTP", "GET", "POST", "HEAD", "STATUS")

# Fixed value: dotted quad without range check, or any run of hex digits and colons.
IP_PATTERN = r"^(\d{1,3}\.){3}\d{1,3}$|^([a-fA-F0-9:]+)$"

REPLACEMENT_CHARACTER = "�"


def stripped(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(value, F.lit(" \t\n\r\f\v"))


def is_junk_line(value: Column) -> Column:
    starts = value.rlike(r'^\s*"*\s*(?:' + "|".join(JUNK_STARTS) + ")")
    # the plain search spares most lines the second regex
    return starts | (value.contains(JUNK_ARROW) & value.rlike(JUNK_BANNER))


def unwrap_line(value: Column) -> Column:
    """Peel spreadsheet quotes off a log record and collapse runs of quotes."""
    line = stripped(value)
    marked = reduce(or_, [line.contains(m) for m in WRAPPED_RECORD_MARKERS])
    quoted = line.startswith('"') & line.endswith('"') & marked
    peeled = F.when(quoted, F.regexp_replace(line, r'^("+)(.*)\1$', "$2")).otherwise(line)
    folded = F.regexp_replace(peeled, r'"{2,}', '"')
    return F.when(peeled.contains('""'), folded).otherwise(peeled)


def is_number_text(value: Column) -> Column:
    """Digits only once dots and minus signs are dropped."""
    return F.translate(stripped(value), ".-", "").rlike(r"^[0-9]+$")


def looks_like_header_cell(value: Column) -> Column:
    cell = stripped(value)
    return (cell != "") & (F.length(cell) < 30) & ~is_number_text(value)


def is_valid_ip(value: Column) -> Column:
    return value.cast("string").rlike(IP_PATTERN)


def is_valid_http_status(value: Column, data_type: str) -> Column:
    """Whole-number codes 100 to 599. Text must be a whole number; fractions truncate."""
    if data_type in ("string", "boolean"):
        code = stripped(value.cast("string"))
        number = F.when(code.rlike(r"^[+-]?\d+$"), code.try_cast("bigint"))
    else:
        number = value.try_cast("bigint")
    return F.coalesce(number.between(100, 599), F.lit(False))
