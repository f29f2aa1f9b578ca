"""First, middle and last slice of an ordered table, without sorting it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.operators.ranks import order_statistics, whole_order_statistics

MIN_SLICE_ROWS = 1000


def slice_positions(rows: int, fraction: float, minimum: int) -> list[tuple[int, int]]:
    """Half-open position ranges of the three slices, cut to the table."""
    size = max(int(rows * fraction), minimum)
    starts = (0, max(rows // 2 - size // 2, 0), max(rows - size, 0))
    return [(s, min(s + size, rows)) for s in starts]


def head_mid_tail_slices(
    df: DataFrame, order_by: str, fraction: float = 0.10, minimum: int = MIN_SLICE_ROWS
) -> list[DataFrame]:
    """Three position ranges by a unique number or time column.

    The keys at the ends of each range are found as exact order statistics; the slices
    are then plain filters, so nothing is sorted and no row gets a global number.
    """
    kind = df.schema[order_by].dataType.typeName()
    key = F.col(f"`{order_by}`")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        key, kind = F.unix_micros(key.cast("timestamp")), "long"
    whole = kind in ("byte", "short", "integer", "long")
    key = key.cast("bigint" if whole else "double")
    keys = df.select(key.alias("x")).where(F.col("x").isNotNull())
    rows = keys.count()
    ranges = slice_positions(rows, fraction, minimum)
    wanted = {r for start, end in ranges if end > start for r in (start, end - 1)}
    statistics = whole_order_statistics if whole else _double_order_statistics
    found = statistics(keys, rows, wanted) if wanted else {}
    ends = [found[r] for r in wanted]
    if ends:
        repeated = keys.where(F.col("x").isin(*ends)).groupBy("x").count().where("count > 1")
        if not repeated.isEmpty():
            raise ValueError(f"'{order_by}' is not unique, slices would be ambiguous.")
    return [
        df.where(key.between(found[start], found[end - 1])) if end > start else df.limit(0)
        for start, end in ranges
    ]


def _double_order_statistics(keys: DataFrame, rows: int, wanted: set[int]) -> dict[int, float]:
    return order_statistics(keys.select(F.lit(0).alias("i"), "x"), {0: rows}, {0: wanted})[0]


def head_mid_tail_sample(
    df: DataFrame, order_by: str, fraction: float = 0.10, minimum: int = MIN_SLICE_ROWS
) -> DataFrame:
    """The three slices together, equal rows once."""
    slices = head_mid_tail_slices(df, order_by, fraction, minimum)
    return reduce(DataFrame.unionByName, slices).dropDuplicates()
