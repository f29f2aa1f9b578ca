"""Equal-width histograms of many columns in one grouped pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.operators.table import ColumnInfo, merged, stacked

MAX_BINS = 20
COLUMNS_PER_JOB = 64


def bin_edges(count: int, low: float, high: float) -> np.ndarray | None:
    """Edges of ``min(20, count // 5)`` bins; None below five values or without a range."""
    if count < 5 or not (math.isfinite(low) and math.isfinite(high)):
        return None
    if low == high:
        low, high = low - 0.5, high + 0.5
    return np.linspace(low, high, min(MAX_BINS, count // 5) + 1)


def bin_index(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Bin of a value: the scaled guess, moved one step where the edges disagree.

    Every bin is closed on the left; the last one also on the right. Edges follow the
    same arithmetic as evenly spaced numpy edges, so they are equal to the last bit.
    """
    step = (high - low) / bins
    guess = F.floor((value - low) / (high - low) * bins).cast("int")
    guess = F.greatest(F.lit(0), F.least(guess, bins - 1))
    left, right = guess * step + low, (guess + 1) * step + low
    return (
        F.when(value < left, guess - 1)
        .when((guess < bins - 1) & (value >= right), guess + 1)
        .otherwise(guess)
    )


def histogram_counts(
    data: DataFrame, columns: list[ColumnInfo], edges: dict[int, np.ndarray]
) -> dict[int, list[int]]:
    """Counts per bin, empty bins included."""
    wanted = [c for c in columns if c.ordinal in edges]
    if not wanted:
        return {}
    chunks = [wanted[k:k + COLUMNS_PER_JOB] for k in range(0, len(wanted), COLUMNS_PER_JOB)]

    def run(chunk):
        # one small expression for all columns, with the range looked up per column
        size = chunk[-1].ordinal + 1
        low, high, bins = [0.0] * size, [1.0] * size, [1] * size
        for c in chunk:
            e = edges[c.ordinal]
            low[c.ordinal], high[c.ordinal] = float(e[0]), float(e[-1])
            bins[c.ordinal] = len(e) - 1
        place = F.col("i")
        bin_of = bin_index(
            F.col("x"), *[F.get(F.lit(v), place) for v in (low, high, bins)]
        )
        long = stacked(data, {c.ordinal: c.number() for c in chunk})
        rows = long.groupBy("i", bin_of.alias("bin")).agg(F.count("*").alias("n"))
        return {(r.i, r.bin): r.n for r in rows.collect()}

    counted = merged(run, chunks)
    return {
        i: [counted.get((i, b), 0) for b in range(len(e) - 1)] for i, e in edges.items()
    }
