"""Reading time stamps from text in the usual log and table formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in this order before a general parse.
TIMESTAMP_FORMATS = (
    "dd/MMM/yyyy:HH:mm:ss,Z",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)

TIME_TYPES = ("timestamp", "timestamp_ntz", "date")


def parse_with(value: Column, pattern: str) -> Column:
    return F.try_to_timestamp(value, F.lit(pattern))


def parse_any(value: Column, data_type: str) -> Column:
    """A timestamp from a time column or from text in any known format."""
    if data_type in TIME_TYPES:
        return value.cast("timestamp")
    if data_type != "string":
        return F.lit(None).cast("timestamp")
    tries = [parse_with(value, p) for p in TIMESTAMP_FORMATS]
    return F.coalesce(*tries, value.try_cast("timestamp"))


def freshness_status(age_days: Column) -> Column:
    return (
        F.when(age_days.isNull(), F.lit(None).cast("string"))
        .when(age_days <= 7, "FRESH")
        .when(age_days <= 30, "STALE")
        .otherwise("VERY_STALE")
    )
