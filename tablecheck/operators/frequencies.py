"""Value counts, distinct counts and first values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.operators.table import (
    OPAQUE,
    TEXT,
    ColumnInfo,
    collect_aggregates,
    stacked,
)
from tablecheck.session import small_frame


def text_value(column: ColumnInfo) -> Column:
    """Text as it is; values without an order of their own as a digest."""
    value = F.col(column.key)
    if column.kind != OPAQUE:
        return value.cast("string")
    if column.data_type.split("<")[0] in ("array", "map", "struct", "variant"):
        return F.sha2(F.to_json(value), 256)
    if column.data_type == "binary":
        return F.sha2(value, 256)
    return value.cast("string")


# Characters of a text that are moved with its digest; shorter texts are moved whole.
PREFIX = 32


def value_counts(data: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """Long frame ``(i, value, n)``; hot values are combined before the shuffle."""
    long = stacked(data, {c.ordinal: text_value(c) for c in columns}, "value")
    return long.groupBy("i", "value").agg(F.count("*").alias("n"))


def with_digest(long: DataFrame) -> DataFrame:
    """``start``, ``h1``, ``h2`` instead of ``value``: the first characters and, for what is longer,
    128 bits of digest. These tell values apart as the values themselves do."""
    value, longer = F.col("value"), F.length("value") > PREFIX
    return long.withColumns(
        {
            "start": F.substring(value, 1, PREFIX),
            "h1": F.when(longer, F.xxhash64(value)),
            "h2": F.when(longer, F.xxhash64(F.lit(7), value)),
        }
    )


def digest_counts(data: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """Long frame ``(i, start, h1, h2, n)``: like :func:`value_counts`, without moving long texts."""
    long = stacked(data, {c.ordinal: text_value(c) for c in columns}, "value")
    keys = ["i", "start", "h1", "h2"]
    return with_digest(long).select(keys).groupBy(keys).agg(F.count("*").alias("n"))


def leaders(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent digests of each column, ties by the start of the text, and one more, which
    tells whether the last place is contested. Each task keeps as many."""
    order = Window.partitionBy("i").orderBy(F.desc("n"), "start", "h1", "h2")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit + 1).drop("rank")


def with_values(data: DataFrame, columns: list[ColumnInfo], found: list, limit: int) -> dict:
    """Per column the top values ``(rank, value, n)`` of leaders ``found``, in order.

    Short ones are known from their start. Long ones are fetched by their digests. Where long texts
    that start alike and are equally frequent contest the last places, the texts with that start are
    counted as they are. Both are scans that move the texts in question alone.
    """
    groups: dict = {c.ordinal: [] for c in columns}
    for row in found:
        groups.get(row.i, []).append(row)
    tops: dict = {i: [] for i in groups}
    fetched, contested = [], []
    for i, rows in groups.items():
        rows.sort(key=lambda r: (-r.n, r.start.encode(), r.h1 is not None))
        if len(rows) > limit:
            last, beyond = rows[limit - 1], rows[limit]
            rows = rows[:limit]
            if (last.n, last.start) == (beyond.n, beyond.start):
                rows = [r for r in rows if (r.n, r.start) != (last.n, last.start)]
                contested.append({"i": i, "start": last.start, "n": last.n})
        tops[i] = [(r.start, r.n) for r in rows if r.h1 is None]
        fetched += [{"i": i, "h1": r.h1, "h2": r.h2, "n": r.n} for r in rows if r.h1 is not None]

    def texts(keys):
        values = {c.ordinal: text_value(c) for c in columns if c.ordinal in {k["i"] for k in keys}}
        return with_digest(stacked(data, values, "value"))

    def frame(keys, schema):  # at most ``limit`` keys per column
        return F.broadcast(small_frame(data.sparkSession, keys, schema))

    if fetched:
        keys = frame(fetched, "i int, h1 bigint, h2 bigint, n bigint")
        met = texts(fetched).join(keys, ["i", "h1", "h2"])
        for row in met.groupBy("i", "h1", "h2", "n").agg(F.min("value").alias("value")).collect():
            tops[row.i].append((row.value, row.n))
    if contested:
        keys = frame(contested, "i int, start string, n bigint").withColumnRenamed("n", "wanted")
        met = texts(contested).join(keys, ["i", "start"])
        counted = met.groupBy("i", "value", "wanted").agg(F.count("*").alias("n")).where("n = wanted")
        order = Window.partitionBy("i").orderBy("value")
        first = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        for row in first.collect():
            tops[row.i].append((row.value, row.n))
    # as Spark does, text is ordered by its bytes
    order = lambda x: (-x[1], x[0].encode())
    return {
        i: [(k, *x) for k, x in enumerate(sorted(rows, key=order)[:limit], 1)]
        for i, rows in tops.items()
    }


def top_values(data: DataFrame, columns: list[ColumnInfo], limit: int) -> dict:
    """Per column the most frequent values ``(rank, value, n)``, ties by value."""
    found = leaders(digest_counts(data, columns), limit).collect()
    return with_values(data, columns, found, limit)


def frequency_summary(
    data: DataFrame, columns: list[ColumnInfo], totals: dict[int, int], top: int = 10
) -> tuple[dict, dict]:
    """Per column: distinct values, rare values, sum of ``n log2 n``; and its top values.

    Both parts read the same shuffled counts within one job.
    """
    if not columns:
        return {}, {}
    counts = digest_counts(data, columns)
    size = max(totals) + 1
    total = F.get(F.lit([float(totals.get(i, 0)) for i in range(size)]), F.col("i"))
    summary = counts.groupBy("i").agg(
        F.count("*").alias("distinct"),
        F.count_if(F.col("n") / total < 0.05).alias("rare"),
        F.sum(F.col("n") * F.log2(F.col("n"))).alias("n_log_n"),
    )
    text = [c for c in columns if c.kind == TEXT]
    first = leaders(counts.where(F.col("i").isin([c.ordinal for c in text])), top)
    rows = summary.unionByName(first, allowMissingColumns=True).collect()
    stats = {
        row.i: {"distinct": row["distinct"], "rare": row["rare"], "n_log_n": row["n_log_n"]}
        for row in rows if row["distinct"] is not None
    }
    found = [row for row in rows if row["distinct"] is None]
    return stats, with_values(data, text, found, top)


def distinct_counts(data: DataFrame, columns: list[ColumnInfo]) -> dict[int, int]:
    """Exact distinct counts of fixed-width columns.

    One 64-bit hash is one-to-one on a single value of up to eight bytes, so counting
    hashes counts values.
    """
    if not columns:
        return {}
    hashed = {c.ordinal: _fixed_width_key(c) for c in columns}
    long = stacked(data, hashed, "h").groupBy("i", "h").agg(F.lit(1).alias("seen"))
    rows = long.groupBy("i").agg(F.count("*").alias("n")).collect()
    found = {r.i: r.n for r in rows}
    return {c.ordinal: found.get(c.ordinal, 0) for c in columns}


def is_fixed_width(column: ColumnInfo) -> bool:
    """Everything that is at most eight bytes wide."""
    if column.data_type.startswith("decimal("):
        return int(column.data_type[8:].split(",")[0]) <= 18
    return column.kind in ("numeric", "time")


def _fixed_width_key(column: ColumnInfo) -> Column:
    value = F.col(column.key)
    return F.when(value.isNotNull(), F.xxhash64(value))


def approximate_distinct_counts(data: DataFrame, columns: list[ColumnInfo]) -> dict[int, int]:
    """HyperLogLog++ estimates, for tables where exact counting is not worth a shuffle."""
    if not columns:
        return {}
    keys = {
        c.ordinal: F.xxhash64(text_value(c)) if c.kind in (OPAQUE, TEXT)
        else F.xxhash64(F.col(c.key))
        for c in columns
    }
    guarded = {
        c.ordinal: F.when(F.col(c.key).isNotNull(), keys[c.ordinal]) for c in columns
    }
    long = stacked(data, guarded, "h")
    rows = long.groupBy("i").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    found = {r.i: r.n for r in rows}
    return {c.ordinal: found.get(c.ordinal, 0) for c in columns}


def smallest_values(
    data: DataFrame, wanted: dict[int, Column], limit: int, known: dict | None = None
) -> dict[int, list]:
    """The ``limit`` smallest distinct values per column: one minimum per column and round,
    each beyond the one before. Nothing is sorted and one row per task is moved.
    ``known`` gives minima that were found before (None for a column without values)."""
    known = known or {}
    found: dict[int, list] = {
        i: [known[i]] if known.get(i) is not None else [] for i in wanted
    }
    open_columns = {i: v for i, v in wanted.items() if known.get(i, "") is not None}
    while True:
        open_columns = {i: v for i, v in open_columns.items() if len(found[i]) < limit}
        expressions = {
            i: F.min(v if not found[i] else F.when(v > F.lit(found[i][-1]), v))
            for i, v in open_columns.items()
        }
        if not expressions:
            return found
        for i, value in collect_aggregates(data, expressions).items():
            if value is None:
                del open_columns[i]
            else:
                found[i].append(value)


def first_values(
    data: DataFrame, wanted: dict[int, Column], limit: int, order_by: Column
) -> dict[int, list]:
    """First ``limit`` non-NULL values per column by ``order_by``, ties by value.

    Each column is one top-k that keeps ``limit`` rows per task and never sorts the data.
    """
    out: dict[int, list] = {i: [] for i in wanted}
    items = list(wanted.items())
    for start in range(0, len(items), 50):
        parts = []
        for i, value in items[start:start + 50]:
            one = data.select(order_by.alias("k"), value.alias("v"))
            one = one.where(F.col("v").isNotNull()).orderBy("k", "v").limit(limit)
            rank = F.row_number().over(Window.orderBy("k", "v"))
            parts.append(
                one.select(F.lit(i).alias("i"), rank.alias("r"), F.col("v").cast("string"))
            )
        for row in reduce(DataFrame.unionAll, parts).collect():
            out[row.i].append((row.r, row.v))
    return {i: [v for _, v in sorted(rows)] for i, rows in out.items()}
