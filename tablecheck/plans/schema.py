"""What each column means, with the checks that follow from its meaning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import text, timestamps
from tablecheck.operators.metrics import TableMetrics, finite, share
from tablecheck.operators.table import BOOLEAN, NUMERIC, TEXT, TIME, ColumnInfo
from tablecheck.session import small_frame

# Column names that decide the meaning before the type does.
SEMANTIC_BY_NAME = {
    "ip": "ip_address",
    "timestamp": "timestamp",
    "status": "http_status",
    "method": "http_method",
}
SEMANTIC_BY_KIND = {
    BOOLEAN: "boolean",
    TIME: "datetime",
    NUMERIC: "numeric",
    TEXT: "categorical",
}

COLUMN_SCHEMA = """
    ordinal int, column string, data_type string, semantic_type string,
    missing_count bigint, missing_pct double, unique_count bigint, is_constant boolean,
    sample_values array<string>, min double, max double, mean double, std double,
    invalid_ip_pct double, unparseable_timestamp_pct double, invalid_status_pct double
"""


def semantic_type(column: ColumnInfo, overrides: dict[str, str] | None = None) -> str:
    if overrides and column.name in overrides:
        return overrides[column.name].strip().lower()
    if column.name in SEMANTIC_BY_NAME:
        return SEMANTIC_BY_NAME[column.name]
    return SEMANTIC_BY_KIND.get(column.kind, "unknown")


def column_schema(
    metrics: TableMetrics,
    semantic_overrides: dict[str, str] | None = None,
    order_by: str | None = None,
) -> DataFrame:
    samples = metrics.sample_values(metrics.columns, 3, order_by)
    rows = []
    for c in metrics.columns:
        row = {
            "ordinal": c.ordinal,
            "column": c.name,
            "data_type": c.data_type,
            "semantic_type": semantic_type(c, semantic_overrides),
            "missing_count": metrics.missing(c),
            "missing_pct": metrics.missing_pct(c),
            "unique_count": metrics.distinct(c),
            "is_constant": metrics.distinct(c) <= 1,
            "sample_values": samples[c.ordinal],
        }
        row.update(numeric_enrichment(metrics, c))
        if c.name == "ip":
            row["invalid_ip_pct"] = invalid_ip_pct(metrics, c)
        elif c.name == "timestamp":
            row["unparseable_timestamp_pct"] = unparseable_timestamp_pct(metrics, c)
        elif c.name == "status":
            row["invalid_status_pct"] = invalid_status_pct(metrics, c)
        rows.append(row)
    return small_frame(metrics.spark, rows, COLUMN_SCHEMA)


def numeric_enrichment(metrics: TableMetrics, c: ColumnInfo) -> dict:
    """Range, mean and deviation of numbers; booleans count as 0 and 1."""
    n = metrics.count(c)
    if not n:
        return {}
    if c.kind == NUMERIC:
        return {
            "min": finite(metrics.value(c, "min")),
            "max": finite(metrics.value(c, "max")),
            "mean": metrics.mean(c),
            "std": metrics.std(c),
        }
    if c.kind == BOOLEAN:
        p = metrics.value(c, "true") / n
        return {
            "min": float(p == 1),
            "max": float(p > 0),
            "mean": p,
            "std": math.sqrt(p * (1 - p) * n / (n - 1)) if n > 1 else None,
        }
    return {}


def invalid_ip_pct(metrics: TableMetrics, c: ColumnInfo) -> float | None:
    """Share of present values that do not look like an address."""
    value = F.col(c.key)
    bad = metrics.data.agg(
        F.count_if(value.isNotNull() & ~text.is_valid_ip(value))
    ).first()[0]
    return share(bad, metrics.count(c))


def unparseable_timestamp_pct(metrics: TableMetrics, c: ColumnInfo) -> float | None:
    """Share of all rows without a readable time.

    The first format that reads more than half of the rows decides; if none does, any
    format may read any row.
    """
    value = F.col(c.key)
    if c.kind == TIME:
        return metrics.missing_pct(c)
    tries = [
        F.count(timestamps.parse_with(value.cast("string"), p))
        for p in timestamps.TIMESTAMP_FORMATS
    ]
    anything = F.count(timestamps.parse_any(value, c.data_type))
    *by_format, parsed = metrics.data.agg(*tries, anything).first()
    rows = metrics.row_count
    readable = next((n for n in by_format if n > rows * 0.5), parsed)
    return share(rows - readable, rows)


def invalid_status_pct(metrics: TableMetrics, c: ColumnInfo) -> float | None:
    """Share of all rows whose status is not a code from 100 to 599; NULL is invalid."""
    valid = text.is_valid_http_status(F.col(c.key), c.data_type)
    bad = metrics.data.agg(F.count_if(~valid)).first()[0]
    return share(bad, metrics.row_count)

