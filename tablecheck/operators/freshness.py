"""How recent the data is, from its time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.timestamps import freshness_status, parse_any
from tablecheck.operators.table import NUMERIC, describe_columns

# Parts of names that suggest a time.
TIME_WORDS = ("timestamp", "date", "time", "created", "updated", "modified")

STALE_AFTER_DAYS = 30


def time_columns(df: DataFrame) -> list[str]:
    """Columns named like a time. Numbers are left out: their unit is unknown."""
    return [
        c.name for c in describe_columns(df)
        if c.kind != NUMERIC and any(w in c.name.lower() for w in TIME_WORDS)
    ]


def freshness(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``(column, most_recent_record, age_days, status)`` of the first readable time column.

    Age counts whole elapsed days up to ``as_of`` (default now). No row without one.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    columns = {c.name: c for c in describe_columns(df)}
    names = time_columns(df)
    renamed = df.select(
        *[
            parse_any(F.col(f"`{n}`"), columns[n].data_type).alias(f"t{k}")
            for k, n in enumerate(names)
        ]
    )
    if not names:
        names, renamed = [""], df.select(F.lit(None).cast("timestamp").alias("t0"))
    latest = renamed.agg(*[F.max(f"t{k}").alias(f"t{k}") for k in range(len(names))])
    first = F.coalesce(
        *[
            F.when(
                F.col(f"t{k}").isNotNull(),
                F.struct(F.lit(n).alias("column"), F.col(f"t{k}").alias("latest")),
            )
            for k, n in enumerate(names)
        ]
    )
    elapsed = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("latest")
    age = F.floor(elapsed / F.lit(86_400_000_000.0)).cast("bigint")
    found = latest.select(first.alias("f")).where("f is not null").select("f.*")
    return found.select(
        "column",
        F.to_date("latest").cast("string").alias("most_recent_record"),
        age.alias("age_days"),
        freshness_status(age).alias("status"),
    )
