"""Text as ``(file, position, value)`` lines, and what kind of file they come from.

Detection looks at the first twenty lines of every file, all files in one job.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add
from urllib.parse import unquote

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecheck.functions.text import (
    is_junk_line,
    is_number_text,
    looks_like_header_cell,
    stripped,
    unwrap_line,
)
from tablecheck.sources.formats import LOG_FORMATS

SAMPLE_LINES = 20
SNIFF_LINES = 10
MIN_CONFIDENCE = 0.60

# Separators in order of preference.
DELIMITERS = (",", "\t", "|", ";")

# Traces of log records; three of them in a line make it certain.
LOG_INDICATORS = (
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    r"\[\d{2}/\w+/\d{4}",
    r'"(GET|POST|PUT|DELETE|HEAD|OPTIONS)',
    r"\b(ERROR|WARN|INFO|DEBUG|CRITICAL)\b",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"\b(GET|POST|PUT|DELETE)\s+/\S+",
    r",-,-,",
    r",\d{3},",
    r"[a-f0-9]{4}:[a-f0-9]{4}:",
)


# What bytes 0x80-0x9F mean in windows-1252 (five of them mean nothing).
C1_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0))
C1_AS_WINDOWS_1252 = "".join(
    bytes([c]).decode("windows-1252", errors="replace") for c in range(0x80, 0xA0)
)


def decoded(value: Column, encoding: str) -> Column:
    """Text of raw line bytes; what cannot be read becomes the replacement character."""
    if encoding in ("ascii", "UTF-8"):
        return F.make_valid_utf8(value)
    single_byte = F.decode(value.cast("binary"), "ISO-8859-1")
    if encoding == "windows-1252":
        return F.translate(single_byte, C1_CONTROLS, C1_AS_WINDOWS_1252)
    return single_byte


def read_raw_lines(spark: SparkSession, path) -> DataFrame:
    """Lines as raw bytes, with their file and a key that follows file order."""
    text = spark.read.text(path)
    position = F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return text.select(
        F.col("_metadata.file_path").alias("file"), position.alias("position"), "value"
    )


def file_paths(files) -> list[str]:
    """Paths to read again, from the ``file`` of lines: plain text, with pattern signs escaped."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file)) for file in files]


def row_indices(lines: DataFrame, marked: list) -> list[dict]:
    """``(file, row)`` of a few marked lines, given as (file, position): how many lines of the file
    come before each. One scan whatever their number."""
    block, line = F.col("block"), F.col("line")
    before = [
        F.count_if(
            (F.col("file") == m.file)
            & ((block < m.position.block) | (block == m.position.block) & (line < m.position.line))
        )
        for m in marked
    ]
    flat = lines.select("file", "position.*")
    counts = flat.agg(*[b.alias(f"n{k}") for k, b in enumerate(before)]).first() if before else []
    return [{"file": m.file, "row": n} for m, n in zip(marked, counts)]


def read_lines(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    raw = read_raw_lines(spark, path)
    return raw.withColumn("value", decoded(F.col("value"), encoding))


def head_lines(lines: DataFrame, count: int = SAMPLE_LINES) -> DataFrame:
    """The first lines of every file; each task keeps only ``count`` per file."""
    order = Window.partitionBy("file").orderBy("position")
    numbered = lines.withColumn("line_no", F.row_number().over(order))
    return numbered.where(F.col("line_no") <= count)


def file_heads(lines: DataFrame, count: int = SAMPLE_LINES) -> DataFrame:
    """The first lines of every file, from lines in the order in which they are read.

    A task passes on the first lines of the files that begin in it and drops the rest as they come,
    so nothing is ordered but these.
    """
    flat = lines.where("position.block = 0").select("file", "position", "value")
    return flat.mapInArrow(
        lambda batches: _heads(batches, count),
        "file string, position struct<block:bigint,line:bigint>, value string",
    )


def _heads(batches, count: int):
    file, seen = None, 0
    for batch in batches:
        start, names = 0, batch.column("file")
        while start < batch.num_rows:
            if names[start].as_py() != file:
                file, seen = names[start].as_py(), 0
            same = pc.equal(names.slice(start), names[start])
            length = pc.index(same, False).as_py()  # of the run of lines of this file
            length = batch.num_rows - start if length < 0 else length
            if seen < count:
                yield batch.slice(start, min(length, count - seen))
            start, seen = start + length, seen + length


def clean_lines(lines: DataFrame) -> DataFrame:
    """Without blank and decoration lines, and without spreadsheet quoting."""
    kept = lines.where(~is_junk_line(F.col("value")))
    return kept.withColumn("value", unwrap_line(F.col("value")))


def sniff_sample(lines: DataFrame) -> DataFrame:
    """One row per file: ``head``, the cleaned first lines in order (ten at most)."""
    # junk lines are left out inside the aggregate, so that a file of junk lines keeps its row
    line = F.struct("line_no", unwrap_line(F.col("value")).alias("value"))
    kept = F.when(~is_junk_line(F.col("value")), line)
    ordered = F.array_sort(F.collect_list(kept))
    head = F.slice(F.transform(ordered, lambda x: x["value"]), 1, SNIFF_LINES)
    return head_lines(lines).groupBy("file").agg(head.alias("head"))


def _share(head: Column, matches) -> Column:
    hits = F.size(F.filter(head, matches)).cast("double")
    return hits / F.greatest(F.size(head), F.lit(1))


def log_likelihood(head: Column) -> Column:
    """Mean over lines of ``min(traces / 3, 1)``."""

    def of_line(line):
        traces = reduce(add, [line.rlike(p).cast("int") for p in LOG_INDICATORS])
        return F.least(traces / F.lit(3.0), F.lit(1.0))

    total = F.aggregate(F.transform(head, of_line), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(head) > 0, total / F.size(head)).otherwise(0.0)


def file_type(file: Column, head: Column) -> Column:
    """``excel``, ``json_log``, ``log`` or ``tabular``; the extension goes first."""
    name = F.lower(file)
    objects = F.filter(
        head, lambda x: stripped(x).startswith("{") & stripped(x).endswith("}")
    )
    many_objects = (F.size(head) > 0) & (F.size(objects) >= F.size(head) * 0.7)
    return (
        F.when(name.endswith(".xlsx") | name.endswith(".xls"), "excel")
        .when(name.endswith(".json"), "json_log")
        .when(many_objects, "json_log")
        .when(log_likelihood(head) > MIN_CONFIDENCE, "log")
        .otherwise("tabular")
    )


def log_format_scores(head: Column) -> dict[str, Column]:
    def share_of(pattern: str) -> Column:
        return _share(head, lambda x: x.rlike(pattern))

    scores = {name: share_of(fmt.pattern) for name, fmt in LOG_FORMATS.items()}
    scores["json_log"] = _share(head, lambda x: stripped(x).startswith("{"))
    return scores


def log_format(head: Column) -> tuple[Column, Column]:
    """Best format (``custom`` below 60%) and its share of lines; first declared wins."""
    scores = log_format_scores(head)
    best = F.greatest(*scores.values())
    name = F.lit("custom")
    for fmt, score in reversed(scores.items()):
        name = F.when(score == best, fmt).otherwise(name)
    return F.when(best < MIN_CONFIDENCE, "custom").otherwise(name), best


def delimiter(head: Column) -> Column:
    """Separator found equally often in every line, else the most frequent, else NULL."""
    def per_line(d: str) -> Column:
        return F.transform(head, lambda x: F.size(F.split(x, f"\\Q{d}\\E", -1)) - 1)

    scored = []
    for place, d in enumerate(DELIMITERS):
        counts = per_line(d)
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        steady = (F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts))
        scored.append(
            F.struct(
                steady.cast("int").alias("steady"),
                total.alias("total"),
                F.lit(-place).alias("preference"),
                F.lit(d).alias("delimiter"),
            )
        )
    best = F.greatest(*scored)
    return F.when(best["total"] > 0, best["delimiter"])


def has_header(head: Column, separator: Column) -> Column:
    """More numbers in line two than in line one, or line one reads like names."""
    pattern = F.concat(F.lit("\\Q"), separator, F.lit("\\E"))
    first = F.split(F.get(head, F.lit(0)), pattern, F.lit(-1))
    second = F.split(F.get(head, F.lit(1)), pattern, F.lit(-1))

    def numbers(cells):
        return F.size(F.filter(cells, is_number_text))

    named = F.size(F.filter(first, looks_like_header_cell)) > F.size(first) * 0.6
    return F.when(F.size(head) < 2, True).otherwise((numbers(second) > numbers(first)) | named)


def detect(lines: DataFrame) -> DataFrame:
    """One row per file with everything that can be told from its first lines."""
    sample = sniff_sample(lines)
    head = F.col("head")
    fmt, confidence = log_format(head)
    found = sample.select(
        "file",
        "head",
        file_type(F.col("file"), head).alias("file_type"),
        log_likelihood(head).alias("log_score"),
        fmt.alias("log_format"),
        confidence.alias("log_confidence"),
        F.coalesce(delimiter(head), F.lit(",")).alias("delimiter"),
        delimiter(head).isNotNull().alias("delimiter_found"),
    )
    return found.withColumn("has_header", has_header(head, F.col("delimiter")))


def encodings(raw_lines: DataFrame) -> DataFrame:
    """Encoding per file, from the raw bytes of all its lines (:func:`read_raw_lines`).

    Valid UTF-8 is taken as such. Otherwise the text is single-byte: ``windows-1252``
    where bytes 0x80-0x9F occur, else ``ISO-8859-1``; the confidence is the share of
    lines beyond ASCII that are no valid UTF-8.
    """
    value = F.col("value")
    beyond = F.octet_length(value) != F.length(F.regexp_replace(value, r"[^\x00-\x7f]", ""))
    invalid = ~F.is_valid_utf8(value)
    control = decoded(value, "ISO-8859-1").rlike(r"[\x80-\x9f]")
    per_file = raw_lines.groupBy("file").agg(
        F.count_if(beyond).alias("beyond_ascii"),
        F.count_if(invalid).alias("invalid_utf8"),
        F.count_if(invalid & control).alias("c1"),
    )
    encoding = (
        F.when(F.col("beyond_ascii") == 0, "ascii")
        .when(F.col("invalid_utf8") == 0, "UTF-8")
        .when(F.col("c1") > 0, "windows-1252")
        .otherwise("ISO-8859-1")
    )
    confidence = F.when(F.col("invalid_utf8") == 0, 1.0).otherwise(
        F.rint(F.col("invalid_utf8") / F.col("beyond_ascii") * 100) / 100
    )
    return per_file.select(
        "file", encoding.alias("encoding"), confidence.alias("confidence"),
        (confidence < 0.7).alias("uncertain"),
    )
