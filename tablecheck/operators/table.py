"""A table made ready for statistics: positional names, NULL instead of NaN, column kinds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, BOOLEAN, TEXT, TIME, OPAQUE = "numeric", "boolean", "text", "time", "opaque"

# Inputs below this planner estimate are spread over all cores and kept between passes.
SMALL_INPUT_BYTES = 256 * 1024 * 1024

# More aggregates than this in one job make generated code too big to be compiled well.
AGGREGATES_PER_JOB = 40


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.NumericType, T.NullType)):
        return NUMERIC
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    return OPAQUE


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    data_type: str
    kind: str

    @property
    def key(self) -> str:
        return f"c{self.ordinal}"

    def number(self) -> Column:
        return F.col(self.key).cast("double")


def describe_columns(df: DataFrame) -> list[ColumnInfo]:
    return [
        ColumnInfo(i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]


def prepared(df: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """Positional names (safe for any header text) and NaN read as missing."""
    renamed = df.toDF(*[c.key for c in columns])
    picked = []
    for c in columns:
        value = F.col(c.key)
        if c.data_type in ("float", "double"):
            value = F.when(~F.isnan(value), value + F.lit(0.0).cast(c.data_type))
        elif c.data_type == "void":
            value = value.cast("double")
        picked.append(value.alias(c.key))
    return renamed.select(*picked)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer believes the input size to be."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_if_small(data: DataFrame, limit: int = SMALL_INPUT_BYTES) -> tuple[DataFrame, bool]:
    """Small inputs often sit in one file block; give every core a share and keep it."""
    if not data.columns or estimated_bytes(data) > limit:
        return data, False
    cores = data.sparkSession.sparkContext.defaultParallelism
    # by value: no sort as for round-robin, and grouping whole rows needs no second shuffle
    plain = [f.name for f in data.schema.fields if kind_of(f.dataType) != OPAQUE]
    spread = data.repartition(cores, *plain) if plain else data.repartition(cores)
    return spread.persist(StorageLevel.MEMORY_AND_DISK), True


def collect_aggregates(
    data: DataFrame, expressions: dict, per_job: int = AGGREGATES_PER_JOB
) -> dict:
    """Evaluate many global aggregates, a bounded number per job.

    Neighbouring keys belong to one column, so each job reads few columns.
    """
    items = list(expressions.items())
    if not items:
        return {}
    chunks = [items[i:i + per_job] for i in range(0, len(items), per_job)]

    def run(chunk):
        row = data.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(chunk)]).first()
        return {key: row[i] for i, (key, _) in enumerate(chunk)}

    return merged(run, chunks)


def merged(run, chunks: list) -> dict:
    """Run one job per chunk, a few at a time, and merge their dictionaries."""
    if len(chunks) == 1:
        return run(chunks[0])
    result: dict = {}
    with ThreadPoolExecutor(max_workers=4) as pool:
        for part in pool.map(run, chunks):
            result.update(part)
    return result


def side_by_side(tasks: list, first=None) -> None:
    """Run driver-side tasks in threads, so that their Spark jobs share the cluster."""
    if first is not None:
        first()
    with ThreadPoolExecutor(max_workers=8) as pool:
        for done in [pool.submit(t) for t in tasks]:
            done.result()


def stacked(data: DataFrame, values: dict[int, Column], per_row: str = "x") -> DataFrame:
    """Long frame ``(i, x)`` of several columns; ``i`` is the column ordinal."""
    wide = data.select(*[v.alias(f"v{i}") for i, v in values.items()])
    ordinals = F.array(*[F.lit(i) for i in values])
    exploded = wide.select(F.posexplode(F.array(*wide.columns)).alias("p", per_row))
    return exploded.select(F.get(ordinals, F.col("p")).alias("i"), per_row).where(
        F.col(per_row).isNotNull()
    )
