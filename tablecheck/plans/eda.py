"""Exploratory statistics: one long frame per section."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.operators.metrics import TableMetrics, finite, half_even, share
from tablecheck.operators.table import TEXT
from tablecheck.plans import wording
from tablecheck.session import small_frame

STRONG, VERY_STRONG, REDUNDANT = 0.7, 0.9, 0.8
# Codes and verbs vary little by nature.
LOW_VARIANCE_EXEMPT = ("status", "http_status", "method", "http_method")
MAX_CO_MISSING, MAX_INSIGHTS = 10, 10

NUMERIC_SUMMARY = """
    ordinal int, column string, count bigint, mean double, median double, std double,
    min double, max double, q1 double, q3 double, iqr double,
    skewness double, kurtosis double, cv double
"""


def numeric_summary(metrics: TableMetrics) -> DataFrame:
    rows = []
    for c in metrics.numeric:
        if not metrics.count(c):
            continue
        mean, std = metrics.mean(c), metrics.std(c)
        q1, q3 = metrics.quartile(c, 0.25), metrics.quartile(c, 0.75)
        values = {
            "mean": mean,
            "median": metrics.quartile(c, 0.5),
            "std": std,
            "min": metrics.value(c, "min"),
            "max": metrics.value(c, "max"),
            "q1": q1,
            "q3": q3,
            "iqr": q3 - q1,
            "skewness": metrics.skewness(c),
            "kurtosis": metrics.kurtosis(c),
            "cv": std / mean if std is not None and mean else None,
        }
        row = {k: half_even(finite(v), 4) for k, v in values.items()}
        rows.append(
            {"ordinal": c.ordinal, "column": c.name, "count": metrics.count(c), **row}
        )
    return small_frame(metrics.spark, rows, NUMERIC_SUMMARY)


# ------------------------------------------------------------------ correlation


def correlation_matrix(metrics: TableMetrics) -> DataFrame:
    """All ordered pairs of numeric columns; empty with fewer than two."""
    columns = metrics.numeric
    rows = []
    if len(columns) > 1:
        rows = [
            {
                "col1": a.name, "col2": b.name,
                "correlation": half_even(metrics.correlation(a, b), 4),
            }
            for a in columns
            for b in columns
        ]
    return small_frame(metrics.spark, rows, "col1 string, col2 string, correlation double")


def _pairs_above(metrics: TableMetrics, limit: float):
    for a, b in combinations(metrics.numeric, 2):
        r = metrics.correlation(a, b)
        if r is not None and abs(r) > limit:
            yield a, b, r


def strong_correlations(metrics: TableMetrics) -> DataFrame:
    rows = [
        {
            "col1": a.name, "col2": b.name, "correlation": half_even(r, 4),
            "type": "positive" if r > 0 else "negative",
            "strength": "very strong" if abs(r) > VERY_STRONG else "strong",
        }
        for a, b, r in _pairs_above(metrics, STRONG)
    ]
    return small_frame(
        metrics.spark, rows,
        "col1 string, col2 string, correlation double, type string, strength string",
    )


# ------------------------------------------------------------------ distributions


def shape_of(skewness: float | None) -> str:
    if skewness is None:
        return "slightly_skewed"
    if abs(skewness) < 0.5:
        return "normal"
    if abs(skewness) > 1:
        return "right_skewed" if skewness > 0 else "left_skewed"
    return "slightly_skewed"


def histograms(metrics: TableMetrics) -> DataFrame:
    """One row per column and bin, with the left edge of the bin."""
    rows = []
    for c in metrics.numeric:
        edges, counts = metrics.histograms.get(c.ordinal, (None, []))
        for b, n in enumerate(counts):
            rows.append(
                {"ordinal": c.ordinal, "column": c.name, "bin": b,
                 "bin_start": half_even(float(edges[b]), 4), "count": n}
            )
    return small_frame(
        metrics.spark, rows,
        "ordinal int, column string, bin int, bin_start double, count bigint",
    )


def distribution_shapes(metrics: TableMetrics) -> DataFrame:
    rows = [
        {"ordinal": c.ordinal, "column": c.name, "shape": shape_of(metrics.skewness(c))}
        for c in metrics.numeric
        if c.ordinal in metrics.histograms
    ]
    return small_frame(metrics.spark, rows, "ordinal int, column string, shape string")


# ------------------------------------------------------------------ text columns


def categorical_summary(metrics: TableMetrics) -> DataFrame:
    rows = [
        {
            "ordinal": c.ordinal, "column": c.name, "unique_count": metrics.distinct(c),
            "total": metrics.count(c), "entropy": half_even(metrics.entropy(c), 4),
        }
        for c in metrics.of_kind(TEXT)
        if metrics.count(c)
    ]
    return small_frame(
        metrics.spark, rows,
        "ordinal int, column string, unique_count bigint, total bigint, entropy double",
    )


def top_values(metrics: TableMetrics) -> DataFrame:
    rows = [
        {
            "ordinal": c.ordinal, "column": c.name, "rank": rank, "value": value,
            "count": n, "pct": share(n, metrics.count(c)),
        }
        for c in metrics.of_kind(TEXT)
        for rank, value, n in metrics.top(c)
    ]
    return small_frame(
        metrics.spark, rows,
        "ordinal int, column string, rank int, value string, count bigint, pct double",
    )


# ------------------------------------------------------------------ outliers

OUTLIERS = """
    ordinal int, column string, count bigint, pct double,
    lower_bound double, upper_bound double, min_outlier double, max_outlier double,
    sample_outliers array<double>
"""


def outlier_analysis(
    metrics: TableMetrics, order_by: str | None = None, samples: int = 5
) -> DataFrame:
    """Columns with values beyond 1.5 interquartile ranges, and their first outliers."""
    first = metrics.first_outliers(samples, order_by) if samples else {}
    rows = []
    for c in metrics.numeric:
        count = metrics.outlier(c, "count")
        if not count:
            continue
        low, high = metrics.outlier_bounds(c)
        rows.append(
            {
                "ordinal": c.ordinal, "column": c.name, "count": count,
                "pct": share(count, metrics.count(c)),
                "lower_bound": half_even(finite(low), 4),
                "upper_bound": half_even(finite(high), 4),
                "min_outlier": half_even(finite(metrics.outlier(c, "min")), 4),
                "max_outlier": half_even(finite(metrics.outlier(c, "max")), 4),
                "sample_outliers": [half_even(v, 4) for v in first.get(c.ordinal, [])],
            }
        )
    return small_frame(metrics.spark, rows, OUTLIERS)


def outlier_rows(metrics: TableMetrics, column: str) -> DataFrame:
    """The rows of the table whose value in ``column`` is an outlier."""
    c = metrics.column(column)
    names = [info.name for info in metrics.columns]
    if metrics.outlier_bounds(c) is None:
        return metrics.source.limit(0)
    return metrics.data.where(metrics.is_outlier(c)).toDF(*names)


# ------------------------------------------------------------------ missing values


def missing_columns(metrics: TableMetrics) -> DataFrame:
    """Columns with missing values, most first, ties in table order."""
    rows = [
        {
            "ordinal": c.ordinal, "column": c.name,
            "missing_count": metrics.missing(c), "missing_pct": metrics.missing_pct(c),
        }
        for c in metrics.columns
        if metrics.missing(c)
    ]
    rows.sort(key=lambda r: (-r["missing_pct"], r["ordinal"]))
    return small_frame(
        metrics.spark, rows,
        "ordinal int, column string, missing_count bigint, missing_pct double",
    )


def co_missing_pairs(metrics: TableMetrics, limit: int | None = MAX_CO_MISSING) -> DataFrame:
    """Pairs of columns that are missing in the same rows; the report shows ten."""
    name = {c.ordinal: c.name for c in metrics.columns}
    pairs = sorted(metrics.co_missing.items())
    rows = [
        {"col1": name[i], "col2": name[j], "co_missing_count": n}
        for (i, j), n in (pairs if limit is None else pairs[:limit])
    ]
    return small_frame(
        metrics.spark, rows, "col1 string, col2 string, co_missing_count bigint"
    )


# ------------------------------------------------------------------ insights


def worst_missing(metrics: TableMetrics):
    """The first column with the highest missing share, or None when nothing is missing."""
    worst = max(metrics.columns, key=metrics.missing, default=None)
    return worst if worst is not None and metrics.missing(worst) else None


def insights(metrics: TableMetrics, limit: int | None = MAX_INSIGHTS) -> DataFrame:
    """Remarkable findings in words, at most ten in the report."""
    found = []
    worst = worst_missing(metrics)
    if worst is not None:
        pct = half_even(metrics.missing(worst) / metrics.row_count * 100, 1)
        found.append(("missing", wording.INSIGHT_MISSING.format(column=worst.name, pct=pct)))
    for a, b, r in _pairs_above(metrics, REDUNDANT):
        text = wording.INSIGHT_CORRELATION.format(
            sign="positive" if r > 0 else "negative", r=half_even(r, 2), a=a.name, b=b.name
        )
        found.append(("correlation", text))
    for c in metrics.numeric:
        g = metrics.skewness(c)
        if metrics.count(c) > 10 and g is not None and abs(g) > 2:
            text = wording.INSIGHT_SKEW.format(
                column=c.name, side="right" if g > 0 else "left", skewness=half_even(g, 2)
            )
            found.append(("distribution", text))
    for c in metrics.numeric:
        mean, std = metrics.mean(c), metrics.std(c)
        if c.name.lower() in LOW_VARIANCE_EXEMPT or not mean or std is None:
            continue
        cv = std / abs(mean)
        if not math.isnan(cv) and cv < 0.01:
            text = wording.INSIGHT_VARIANCE.format(column=c.name, cv=half_even(cv, 4))
            found.append(("variance", text))
    shown = found if limit is None else found[:limit]
    rows = [{"place": k, "type": t, "insight": s} for k, (t, s) in enumerate(shown)]
    return small_frame(metrics.spark, rows, "place int, type string, insight string")


# ------------------------------------------------------------------ one column


def column_card(report, column: str) -> DataFrame:
    """Everything known about one column, side by side."""
    card = report.column_profile.where(F.col("column") == column).select("column")
    sections = {
        "numeric": report.numeric_summary,
        "categorical": report.categorical_summary,
        "outliers": report.outlier_analysis,
        "issue": report.column_issues,
    }
    for name, frame in sections.items():
        fields = [f for f in frame.columns if f not in ("column", "ordinal")]
        packed = frame.select("column", F.struct(*fields).alias(name))
        card = card.join(F.broadcast(packed), "column", "left")
    values = report.top_values.where(F.col("column") == column)
    listed = values.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count", "pct"))).alias(
            "top_values"
        )
    )
    return card.join(F.broadcast(listed), "column", "left")
