"""One call from a path to a typed table and a report on how it was read."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.operators.freshness import STALE_AFTER_DAYS, freshness
from tablecheck.session import small_frame
from tablecheck.sources import delimited, jsonlines, lines, logs

# File name endings that can be read.
EXTENSIONS = (".csv", ".tsv", ".txt", ".log", ".json")

# Sentences of the parse report.
JSON_ARRAY = "Parsed as a standard JSON array."
JSON_OBJECT = "Parsed as a single JSON object (one row)."
NO_HEADERS = "No headers detected — column names auto-generated as col_1, col_2, ..."
UNKNOWN_LOG = (
    "Unknown log format detected. Using best-effort parser. Results may need manual review."
)

# Rows named in the report, of one text column and in all.
DAMAGED_PER_COLUMN, MARKED_ROWS = 5, 20

PARSE_REPORT = """
    file_path string, file_size_mb double, files bigint, file_type string,
    encoding string, encoding_confidence double, delimiter string,
    headers_detected boolean, log_format string, parse_confidence string,
    load_strategy string, rows_loaded bigint, rejected_rows bigint,
    encoding_error_cells bigint, fallback_used boolean,
    corrupted_rows array<struct<file:string,row:bigint>>,
    dialects array<struct<files:bigint,file_type:string,encoding:string,delimiter:string,
        headers_detected:boolean,log_format:string>>,
    freshness struct<column:string,most_recent_record:string,age_days:bigint,status:string>,
    warnings array<string>
"""


@dataclass
class Loaded:
    data: DataFrame
    parse_report: DataFrame
    rejects: DataFrame | None
    warnings: list[str] = field(default_factory=list)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def check_input(spark: SparkSession, path: str):
    """Number and size of the files; raises for missing, empty or unknown input."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)?$", 0))
    unknown = F.min(F.when(~ending.isin(*EXTENSIONS), ending)).alias("unknown")
    try:
        files = list_files(spark, path)
        size = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), unknown).first()
    except AnalysisException as error:
        raise FileNotFoundError(f"File not found: {path}") from error
    if not size.files or not size.bytes:
        raise ValueError("File is empty.")
    if size.unknown is not None:
        allowed = ", ".join(EXTENSIONS)
        raise ValueError(f"Unsupported file extension '{size.unknown}'. Allowed: {allowed}")
    return size


def sanity_warnings(columns: int, rows: int) -> list[str]:
    """Signs that a table was not read well; an empty one is an error."""
    if not columns or not rows:
        raise ValueError("Parsing produced an empty dataset.")
    found = []
    if columns < 2:
        found.append(
            "Only 1 column detected — file may not have parsed correctly. "
            "Check delimiter or file format."
        )
    if rows < 5:
        found.append(f"Only {rows} rows loaded — dataset is very small.")
    return found


def input_warnings(df: DataFrame) -> DataFrame:
    """:func:`sanity_warnings` of a table, one per row."""
    rows = df.agg(F.count("*")).first()[0]
    found = [{"warning": w} for w in sanity_warnings(len(df.columns), rows)]
    return small_frame(df.sparkSession, found, "warning string")


def file_verdicts(spark: SparkSession, path) -> DataFrame:
    """How each file of a folder is to be read: one row per file.

    file, file_type, delimiter, delimiter_found, has_header, log_format, log_confidence, encoding,
    encoding_confidence, uncertain. Kinds are told from the first lines, encodings from all bytes.
    """
    coded = lines.encodings(lines.read_raw_lines(spark, path))
    # traces, separators and brackets are ASCII, so any encoding will do for the kind
    found = lines.detect(lines.file_heads(lines.read_lines(spark, path)))
    return found.drop("head", "log_score").join(
        coded.withColumnRenamed("confidence", "encoding_confidence"), "file"
    )


@dataclass(frozen=True)
class Dialect:
    """What the files of one group have in common; each group is read by one reader."""

    file_type: str
    encoding: str
    delimiter: str | None
    headers_detected: bool | None
    log_format: str | None

    @classmethod
    def of(cls, verdict):
        tabular, log = verdict.file_type == "tabular", verdict.file_type == "log"
        return cls(
            verdict.file_type,
            # ASCII is UTF-8 too: such files need no group of their own
            "UTF-8" if verdict.encoding == "ascii" else verdict.encoding,
            verdict.delimiter if tabular else None,
            verdict.has_header if tabular else None,
            verdict.log_format if log else None,
        )


def load(spark: SparkSession, path: str, as_of: Column | None = None) -> Loaded:
    """Read a file, or a folder of files, whatever their formats.

    Every file is read in its own dialect; files of one dialect are one group and one reader. The
    rows of all groups are united by column name, with text where their types disagree.
    """
    size = check_input(spark, path)
    verdicts = file_verdicts(spark, path).orderBy("file").collect()  # one row per file
    if not verdicts:
        raise ValueError("Parsing produced an empty dataset.")
    groups: dict[Dialect, list] = {}
    for verdict in verdicts:
        groups.setdefault(Dialect.of(verdict), []).append(verdict)
    parts = []
    for dialect, files in groups.items():
        paths = path if len(groups) == 1 else lines.file_paths(x.file for x in files)
        parts.append(_load_group(spark, paths, dialect, files))
    data = _united([part.data for part in parts])
    several = len(parts) > 1
    warnings = []
    for part in parts:
        name = unquote(part.files[0].file.rsplit("/", 1)[1])
        of = f" [{len(part.files)} file(s), first {name}]" if several else ""
        warnings.extend(w + of for w in part.warnings)
    rows = sum(part.data.count() if part.rows is None else part.rows for part in parts)
    warnings.extend(sanity_warnings(len(data.columns), rows))
    report = _summary(parts, len(data.columns)) | {
        "file_path": path,
        "file_size_mb": round(size.bytes / 1024 / 1024, 2),
        "files": size.files,
        "load_strategy": "full_load",
        "rows_loaded": rows,
        "corrupted_rows": [r for part in parts for r in part.report["corrupted_rows"]][:MARKED_ROWS],
    }
    recent = freshness(data, as_of).first()
    if recent is not None:
        report["freshness"] = recent.asDict()
        if recent.age_days > STALE_AFTER_DAYS:
            warnings.append(
                f"Data freshness warning: Most recent record in '{recent['column']}' "
                f"is {recent.age_days} days old. Data may be stale."
            )
    report["warnings"] = warnings
    rejects = [part.rejects.select("value") for part in parts if part.rejects is not None]
    rejects = reduce(DataFrame.unionByName, rejects) if rejects else None
    return Loaded(data, small_frame(spark, [report], PARSE_REPORT), rejects, warnings)


@dataclass
class _Part:
    """One group as it was read."""

    files: list
    report: dict
    warnings: list[str]
    data: DataFrame | None = None
    rejects: DataFrame | None = None
    rows: int | None = None


def _load_group(spark, path, dialect: Dialect, files: list) -> _Part:
    part = _Part(files, asdict(dialect), [])
    worst = min(files, key=lambda x: (x.encoding_confidence, x.file))
    names = {x.encoding for x in files}
    part.report |= {
        "files": len(files), "encoding": names.pop() if len(names) == 1 else dialect.encoding,
        "encoding_confidence": worst.encoding_confidence, "rejected_rows": 0,
        "encoding_error_cells": 0, "fallback_used": False, "corrupted_rows": [],
    }
    if worst.uncertain:
        part.warnings.append(
            f"Encoding detection confidence is low ({round(worst.encoding_confidence * 100)}%). "
            f"Detected as {worst.encoding}. Consider specifying encoding manually."
        )
    if dialect.file_type == "json_log" or dialect.log_format == "json_log":
        _load_json(spark, path, dialect, part)
    elif dialect.file_type == "log":
        _load_log(spark, path, dialect, part)
    else:
        _load_delimited(spark, path, dialect, part)
    return part


def _united(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; double where number types differ, else text."""
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            kinds.setdefault(name.lower(), set()).add(kind)

    def fitted(frame):
        columns = []
        for name, kind in frame.dtypes:
            seen, value = kinds[name.lower()], F.col(f"`{name}`")
            if len(seen) > 1:
                plain = kind.startswith(("struct", "array", "map"))
                text = F.to_json(value) if plain else value.cast("string")
                value = value.cast("double") if seen == {"bigint", "double"} else text
            columns.append(value.alias(name))
        return frame.select(columns)

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [fitted(f) for f in frames]
    )


def _summary(parts: list[_Part], columns: int) -> dict:
    """The parse report of all groups: what they share, sums, and one entry per dialect."""
    def shared(name, other=None):
        seen = {part.report[name] for part in parts}
        return seen.pop() if len(seen) == 1 else other

    sums = ("rejected_rows", "encoding_error_cells")
    found = {name: sum(part.report[name] for part in parts) for name in sums}
    found |= {name: shared(name) for name in ("encoding", "delimiter", "headers_detected", "log_format")}
    found["file_type"] = shared("file_type", "mixed")
    found["encoding_confidence"] = min(part.report["encoding_confidence"] for part in parts)
    found["fallback_used"] = any(part.report["fallback_used"] for part in parts)
    found["parse_confidence"] = "low" if columns < 2 else _confidence(parts)
    inner = ("files", "file_type", "encoding", "delimiter", "headers_detected", "log_format")
    found["dialects"] = [{name: part.report[name] for name in inner} for part in parts]
    return found


def _confidence(parts: list[_Part]) -> str | None:
    """The lowest of the groups: low, then medium, shares of matched lines, high, not stated."""
    seen = {part.report.get("parse_confidence") for part in parts}
    for name in ("low", "medium"):
        if name in seen:
            return name
    shares = sorted((s for s in seen if s and s.endswith("%")), key=lambda s: int(s[:-1]))
    return shares[0] if shares else ("high" if "high" in seen else None)


def _load_json(spark, path, dialect, part):
    part.data, part.rejects, shapes = jsonlines.read_json_files(spark, path, dialect.encoding)
    seen = shapes.agg(
        F.count_if("is_array").alias("arrays"),
        F.count_if(~F.col("is_array") & (F.col("shape") == "spread")).alias("objects"),
    ).first()
    if seen.arrays:
        part.warnings.append(JSON_ARRAY)
    if seen.objects:
        part.warnings.append(JSON_OBJECT)
    bad = part.rejects.count()
    part.report["rejected_rows"] = bad
    if bad:
        part.warnings.append(f"{bad} JSON lines could not be parsed and were skipped.")


def _load_log(spark, path, dialect, part):
    text = lines.read_lines(spark, path, dialect.encoding)
    confidence = round(min(x.log_confidence for x in part.files) * 100)
    if dialect.log_format == "custom":
        part.warnings.append(
            f"Log format detection confidence is low ({confidence}%). "
            "Falling back to custom log parser."
        )
        part.warnings.append(UNKNOWN_LOG)
        part.report["parse_confidence"], part.report["fallback_used"] = "low", True
        part.data = logs.parse_custom(text)
        return
    part.report["parse_confidence"] = f"{confidence}%"
    part.rejects = logs.log_rejects(text, dialect.log_format)
    bad = part.rejects.count()
    part.report["rejected_rows"] = bad
    if bad:
        part.warnings.append(
            f"{bad} log lines did not match the detected format and were recorded as NaN."
        )
        marked = part.rejects.select("file", "position").orderBy("file", "position")
        part.report["corrupted_rows"] = lines.row_indices(text, marked.limit(MARKED_ROWS).collect())
    part.data = logs.parse_log(text, dialect.log_format)


def _load_delimited(spark, path, dialect, part):
    separator, encoding, header = dialect.delimiter, dialect.encoding, dialect.headers_detected
    part.report["parse_confidence"] = "high"
    found = all(x.delimiter_found for x in part.files)
    if not found:
        part.warnings.append("Could not detect delimiter clearly. Defaulting to comma.")
    found_rows, survey = _surveyed(spark, path, separator, header, encoding)
    if not found or survey.rejects and survey.rejects >= survey.rows:
        best = delimited.rank_fallbacks(spark, path).first()
        if best.columns > 1 and (not found or best.rejects < survey.rejects):
            separator, encoding = best.separator, best.encoding
            found_rows, survey = _surveyed(spark, path, separator, header, encoding)
            part.report |= {
                "delimiter": separator, "encoding": encoding,
                "fallback_used": True, "parse_confidence": "medium",
            }
            part.warnings.append(
                "Primary parsing failed. Successfully parsed using fallback: "
                f"delimiter='{separator}', encoding='{encoding}'."
            )
    if not header:
        part.warnings.append(NO_HEADERS)
    bad, damaged = survey.rejects, sum(survey.damaged.values())
    part.report["rejected_rows"] = bad
    if bad:
        part.warnings.append(f"{bad} rows have more cells than columns and were set aside.")
    rows, part.rejects = delimited.united(found_rows)
    names = list(survey.cells)
    cells = rows.select([f"`{c}`" for c in names])
    if damaged:
        part.report["encoding_error_cells"] = damaged
        part.warnings.append(f"{damaged} cells had encoding errors. Values replaced with NULL.")
        marked = delimited.damaged_places(rows, names, DAMAGED_PER_COLUMN, MARKED_ROWS)
        located = rows.select(F.col("_file").alias("file"), F.col("_position").alias("position"))
        part.report["corrupted_rows"] = lines.row_indices(located, marked)
        cells = delimited.without_damaged_cells(cells)
    part.rows = survey.rows
    part.data = delimited.typed(cells, survey.types())


def _surveyed(spark, path, separator, header, encoding):
    found = delimited.readings(spark, path, separator, header, encoding, ("file", "position"))
    return found, reduce(delimited.Survey.merged, [reading.survey() for reading in found])
