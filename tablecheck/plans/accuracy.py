"""Does the report find what is known to be wrong? Planted defects and known figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.operators.metrics import TableMetrics
from tablecheck.operators.ranks import order_statistics
from tablecheck.operators.table import NUMERIC, collect_aggregates, describe_columns
from tablecheck.session import small_frame


@dataclass(frozen=True)
class Defects:
    """How many defects of each kind to plant; all hit different rows."""

    missing_column: str
    missing: int
    duplicates: int
    outlier_column: str
    outliers: int
    outlier_values: tuple[float, float] = (-500.0, 999.0)
    constant_column: str = "constant_col"
    constant_value: str = "FIXED"


def inject_defects(df: DataFrame, key: str, defects: Defects, seed: int = 42) -> DataFrame:
    """The table with exactly the wanted defects and a column ``planted`` naming them.

    Rows are picked by the order of a hash of the unique ``key``: three exact order
    statistics split the hash range, so picking is a filter and needs no sort. Copies
    and their originals carry no other defect.
    """
    # 53 bits are exact in a double, which is what order statistics work on
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), 11)
    drawn = df.withColumn("_draw", draw.cast("double"))
    keys = drawn.select(F.lit(0).alias("i"), F.col("_draw").alias("x"))
    total = df.count()
    sizes = (defects.missing, defects.duplicates, defects.outliers)
    if sum(sizes) > total:
        raise ValueError("More defects than rows.")
    ends, position = [], 0
    for size in sizes:
        position += size
        ends.append(position)
    wanted = {0: {e - 1 for e in ends if e > 0}}
    found = order_statistics(keys, {0: total}, wanted)[0] if wanted[0] else {}

    def up_to(end: int) -> Column:
        return F.col("_draw") <= found[end - 1] if end else F.lit(False)

    kind = (
        F.when(up_to(ends[0]), "missing")
        .when(up_to(ends[1]), "duplicate")
        .when(up_to(ends[2]), "outlier")
        .otherwise("none")
    )
    marked = drawn.withColumn("planted", kind)
    low, high = defects.outlier_values
    extreme = F.when(F.col("_draw") % 2 == 0, low).otherwise(high)
    marked = marked.withColumn(
        defects.outlier_column,
        F.when(F.col("planted") == "outlier", extreme).otherwise(
            F.col(f"`{defects.outlier_column}`").cast("double")
        ),
    )
    marked = marked.withColumn(
        defects.missing_column,
        F.when(F.col("planted") != "missing", F.col(f"`{defects.missing_column}`")),
    )
    marked = marked.withColumn(defects.constant_column, F.lit(defects.constant_value))
    copies = marked.where(F.col("planted") == "duplicate")
    return marked.unionByName(copies).drop("_draw")


def planted_counts(damaged: DataFrame, defects: Defects) -> DataFrame:
    """Ground truth per kind of defect, read off the marks."""
    rows = damaged.agg(
        F.count_if(F.col("planted") == "missing").alias("missing"),
        (F.count_if(F.col("planted") == "duplicate") / 2).cast("bigint").alias("duplicates"),
        F.count_if(F.col("planted") == "outlier").alias("outliers"),
        F.count("*").alias("rows"),
    )
    return rows.select(
        "rows", "missing", "duplicates", "outliers",
        F.lit(defects.constant_column).alias("constant_column"),
    )


def detection_report(damaged: DataFrame, defects: Defects) -> DataFrame:
    """``(defect, planted, detected, matched)`` per kind, and precision and recall of the
    outlier rule row by row."""
    truth = planted_counts(damaged, defects).first()
    metrics = TableMetrics(damaged.drop("planted"))
    gap = metrics.column(defects.missing_column)
    flat = metrics.column(defects.constant_column)
    spread = metrics.column(defects.outlier_column)
    low, high = metrics.outlier_bounds(spread)
    value = F.col(f"`{defects.outlier_column}`")
    flagged = (value < low) | (value > high)
    hits = damaged.agg(
        F.count_if(flagged & (F.col("planted") == "outlier")).alias("hit"),
        F.count_if(flagged).alias("flagged"),
    ).first()
    found = [
        ("missing", truth.missing, metrics.missing(gap)),
        ("duplicates", truth.duplicates, metrics.duplicate_rows),
        ("constant", 1, int(metrics.distinct(flat) <= 1)),
        ("outliers", truth.outliers, hits.flagged),
    ]
    rows = [
        {
            "defect": name, "planted": planted, "detected": detected,
            "matched": planted == detected,
            "precision": None, "recall": None,
        }
        for name, planted, detected in found
    ]
    rows[-1]["precision"] = hits.hit / hits.flagged if hits.flagged else None
    rows[-1]["recall"] = hits.hit / truth.outliers if truth.outliers else None
    metrics.release()
    return small_frame(
        damaged.sparkSession, rows,
        "defect string, planted bigint, detected bigint, matched boolean, "
        "precision double, recall double",
    )


def compare_with_known(
    metrics: TableMetrics, known: dict[str, float], tolerance: float = 0.01
) -> DataFrame:
    """``(figure, known, found, within)``. Figures are ``rows``, ``duplicate_rows`` or
    ``missing_pct:<column>``; ``tolerance`` is relative."""
    rows = []
    for figure, expected in known.items():
        if figure == "rows":
            found = float(metrics.row_count)
        elif figure == "duplicate_rows":
            found = float(metrics.duplicate_rows)
        else:
            found = metrics.missing_pct(metrics.column(figure.split(":", 1)[1]))
        close = found is not None and abs(found - expected) <= tolerance * abs(expected)
        rows.append(
            {"figure": figure, "known": float(expected), "found": found, "within": close}
        )
    return small_frame(
        metrics.spark, rows, "figure string, known double, found double, within boolean"
    )


def expectations(
    df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """``(column, expectation, failing_rows, passed)``: no value missing, and numbers within
    a range. Without ``ranges`` each number column is held to its own range."""
    columns = describe_columns(df)
    data = df.toDF(*[c.key for c in columns])
    numeric = [c for c in columns if c.kind == NUMERIC]
    limits = dict(ranges or {})
    if ranges is None:
        ends = {}
        for c in numeric:
            ends[(c.name, 0)] = F.min(c.number())
            ends[(c.name, 1)] = F.max(c.number())
        own = collect_aggregates(data, ends)
        limits = {
            c.name: (own[(c.name, 0)], own[(c.name, 1)])
            for c in numeric
            if own[(c.name, 0)] is not None
        }
    wanted = {}
    for c in columns:
        wanted[(c.ordinal, c.name, "not_null")] = F.count_if(F.col(c.key).isNull())
        if c.name in limits:
            low, high = limits[c.name]
            outside = ~c.number().between(low, high)
            wanted[(c.ordinal, c.name, "in_range")] = F.count_if(outside)
    counts = collect_aggregates(data, wanted)
    rows = [
        {"ordinal": i, "column": name, "expectation": e, "failing_rows": n, "passed": n == 0}
        for (i, name, e), n in counts.items()
    ]
    return small_frame(
        df.sparkSession, rows,
        "ordinal int, column string, expectation string, failing_rows bigint, passed boolean",
    )
