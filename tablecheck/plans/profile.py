"""Profile of a table: one row for the table, one per column, and log metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.timestamps import parse_any
from tablecheck.operators.frequencies import top_values
from tablecheck.operators.metrics import TableMetrics, finite, half_even, share
from tablecheck.operators.table import BOOLEAN, NUMERIC, TEXT
from tablecheck.session import small_frame

# Status codes counted as server errors.
ERROR_STATUS = (500, 502, 503)

COLUMN_PROFILE = """
    ordinal int, column string, kind string,
    missing_count bigint, missing_pct double, unique_count bigint,
    true_count bigint, false_count bigint, true_pct double,
    min double, max double, mean double, median double, std double,
    zero_count bigint, outlier_count bigint,
    most_frequent string, most_frequent_pct double, rare_value_count bigint
"""
TABLE_PROFILE = """
    row_count bigint, column_count int, duplicate_rows bigint, duplicate_pct double,
    error_rate_pct double
"""


def column_basics(metrics: TableMetrics) -> DataFrame:
    """What the generated rules need; spares the passes for quantiles and moments."""
    rows = [_basics(metrics, c) for c in metrics.columns]
    return small_frame(
        metrics.spark, rows,
        "ordinal int, column string, kind string, missing_count bigint, "
        "missing_pct double, unique_count bigint",
    )


def _basics(metrics: TableMetrics, c) -> dict:
    return {
        "ordinal": c.ordinal,
        "column": c.name,
        "kind": c.kind,
        "missing_count": metrics.missing(c),
        "missing_pct": metrics.missing_pct(c),
        "unique_count": metrics.distinct(c),
    }


def column_profile(metrics: TableMetrics) -> DataFrame:
    rows = []
    for c in metrics.columns:
        row = _basics(metrics, c)
        if metrics.count(c):
            row.update(_kind_profile(metrics, c))
        rows.append(row)
    return small_frame(metrics.spark, rows, COLUMN_PROFILE)


def _kind_profile(metrics: TableMetrics, c) -> dict:
    if c.kind == BOOLEAN:
        true = metrics.value(c, "true")
        return {
            "true_count": true,
            "false_count": metrics.count(c) - true,
            "true_pct": share(true, metrics.count(c)),
        }
    if c.kind == NUMERIC:
        return {
            "min": finite(metrics.value(c, "min")),
            "max": finite(metrics.value(c, "max")),
            "mean": metrics.mean(c),
            "median": finite(metrics.quartile(c, 0.5)),
            "std": metrics.std(c),
            "zero_count": metrics.value(c, "zeros"),
            "outlier_count": metrics.outlier(c, "count") or 0,
        }
    if c.kind == TEXT and metrics.top(c):
        _, value, count = metrics.top(c)[0]
        return {
            "most_frequent": value,
            "most_frequent_pct": share(count, metrics.count(c)),
            "rare_value_count": metrics.rare_values(c),
        }
    return {}


def table_profile(metrics: TableMetrics) -> DataFrame:
    row = {
        "row_count": metrics.row_count,
        "column_count": len(metrics.columns),
        "duplicate_rows": metrics.duplicate_rows,
        "duplicate_pct": metrics.duplicate_pct,
        "error_rate_pct": error_rate(metrics),
    }
    return small_frame(metrics.spark, [row], TABLE_PROFILE)


# ------------------------------------------------------------------ log metrics


def error_rate(metrics: TableMetrics) -> float | None:
    """Share of status codes 500, 502 and 503 among present ones; None without a column.

    Text codes never count as errors, as they are not numbers.
    """
    c = metrics.column("status")
    if c is None:
        return None
    if c.kind != NUMERIC:
        return 0.0
    errors = metrics.data.agg(F.count_if(F.col(c.key).isin(*ERROR_STATUS))).first()[0]
    return half_even(errors / metrics.count(c) * 100, 2) if metrics.count(c) else 0.0


def status_distribution(metrics: TableMetrics) -> DataFrame:
    """Percent of rows with a status, per status value."""
    c = metrics.column("status")
    if c is None:
        return small_frame(metrics.spark, [], "status string, count bigint, pct double")
    present = metrics.data.where(F.col(c.key).isNotNull())
    counted = present.groupBy(F.col(c.key).cast("string").alias("status")).agg(
        F.count("*").alias("count")
    )
    total = metrics.count(c)
    pct = F.rint(F.col("count") / F.lit(float(total or 1)) * 100 * 100) / 100
    return counted.withColumn("pct", pct)


def top_log_values(metrics: TableMetrics, column: str, limit: int = 5) -> DataFrame:
    """Most frequent values of a log column, ties by value."""
    c = metrics.column(column)
    if c is None:
        return small_frame(metrics.spark, [], "rank int, value string, count bigint")
    found = top_values(metrics.data, [c], limit)[c.ordinal]
    rows = [{"rank": k, "value": value, "count": n} for k, value, n in found]
    return small_frame(metrics.spark, rows, "rank int, value string, count bigint")


def time_span(metrics: TableMetrics, column: str = "timestamp") -> DataFrame:
    """Earliest and latest readable time of a column."""
    c = metrics.column(column)
    if c is None:
        return small_frame(metrics.spark, [], "start timestamp, end timestamp")
    parsed = metrics.data.select(parse_any(F.col(c.key), c.data_type).alias("t"))
    return parsed.agg(F.min("t").alias("start"), F.max("t").alias("end"))
