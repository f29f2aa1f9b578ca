"""Rounding, ratios and number text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value, which is what numpy does."""
    scale = 10.0 ** digits
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent; NULL when ``whole`` is zero."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return round_even(ratio * F.lit(100.0), digits)


def float_text(value: Column, digits: int = 2) -> Column:
    """Shortest decimal text of a value already rounded to ``digits`` places.

    Always keeps one decimal (``100.0``) and never switches to an exponent.
    """
    fixed = value.cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def json_safe(value: Column) -> Column:
    """NaN and infinities become NULL so that the value can be written as JSON."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~(F.isnan(value) | infinite), value)


def numeric_or_null(value: Column, to: str = "double") -> Column:
    """Coerce text to a number; anything unreadable becomes NULL."""
    return value.try_cast(to)


def bias_corrected_skewness(population_skewness: Column, count: Column) -> Column:
    """Sample skewness from the population one: 0 when constant, NULL below three values."""
    n = count.cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(count >= 3, F.coalesce(factor * population_skewness, F.lit(0.0)))


def bias_corrected_kurtosis(population_kurtosis: Column, count: Column) -> Column:
    """Sample excess kurtosis from the population one: 0 when constant, NULL below four."""
    n = count.cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    value = scale * ((n + 1) * population_kurtosis + 6)
    return F.when(count >= 4, F.coalesce(value, F.lit(0.0)))
