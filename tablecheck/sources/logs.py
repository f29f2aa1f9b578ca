"""Log lines as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.numeric import numeric_or_null
from tablecheck.functions.text import stripped
from tablecheck.sources.formats import LOG_FORMATS, LogFormat
from tablecheck.sources.lines import clean_lines

# Unit separator: joins the groups of one match so that one regex run reads a line. One
# inside the line itself is set aside as U+FFFE, which is no character and never in text.
SEPARATOR, ASIDE = "\u001f", "\ufffe"
# Columns read as numbers.
NUMERIC_COLUMNS = {"status": "bigint", "size": "double"}


def _group(column: str) -> str:
    return column.replace("_", "")


def _joined_groups(fmt: LogFormat, line: Column) -> Column:
    """All groups of the first match in one string; the line itself if nothing matches."""
    names = [_group(c) for c in fmt.columns] + _guards(fmt)
    picked = SEPARATOR.join(f"${{{n}}}" for n in names)
    plain = F.translate(line, SEPARATOR, ASIDE)
    return F.regexp_replace(plain, f"(?s)^.*?{fmt.pattern}.*$", picked)


def _guards(fmt: LogFormat) -> list[str]:
    return sorted(set(fmt.optional.values()))


def parse_log(lines: DataFrame, fmt: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record line; a line of another shape gives a row of NULLs.

    ``lines`` has ``value``; columns named in ``keep`` are passed through.
    """
    shape = LOG_FORMATS[fmt]
    # exploding a single item keeps later filters from repeating the regex
    joined = F.explode(F.array(_joined_groups(shape, F.col("value")))).alias("joined")
    matched = clean_lines(lines).select(*keep, joined)
    groups = F.when(F.col("joined").contains(SEPARATOR), F.split("joined", SEPARATOR, -1))
    parsed = matched.withColumn("fields", groups)
    guards = _guards(shape)
    picked = []
    for k, name in enumerate(shape.columns):
        value = F.translate(F.get("fields", F.lit(k)), ASIDE, SEPARATOR)
        if name in shape.optional:
            guard = F.get("fields", F.lit(len(shape.columns) + guards.index(shape.optional[name])))
            value = F.when(guard != "", value)
        if name in NUMERIC_COLUMNS:
            value = numeric_or_null(value, NUMERIC_COLUMNS[name])
        picked.append(value.alias(name))
    return parsed.select(*keep, *picked)


def log_rejects(lines: DataFrame, fmt: str) -> DataFrame:
    """The record lines that do not have the format, with their place and raw text."""
    raw = lines.withColumn("raw", F.col("value"))
    strange = clean_lines(raw).where(~F.col("value").rlike(LOG_FORMATS[fmt].pattern))
    return strange.select(*[c for c in lines.columns if c != "value"], F.col("raw").alias("value"))


def split_custom(lines: DataFrame) -> DataFrame:
    """``parts``: white-space separated pieces of every line that is not blank."""
    text = lines.withColumn("value", stripped(F.col("value"))).where("value <> ''")
    return text.withColumn("parts", F.split("value", r"\s+")).drop("value")


def parse_custom(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Unknown logs as ``field_1 .. field_n``, short rows filled with NULL."""
    pieces = split_custom(lines)
    width = pieces.agg(F.max(F.size("parts"))).first()[0] or 0
    fields = [F.get("parts", F.lit(k)).alias(f"field_{k + 1}") for k in range(width)]
    return pieces.select(*keep, *fields)
