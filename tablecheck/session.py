"""Session helpers. On a cluster the settings already in the session win."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablecheck")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_frame(
    spark: SparkSession, rows: list[dict], schema: str | T.StructType
) -> DataFrame:
    """A frame of metric rows (their number follows the columns, never the data).

    Going through Arrow keeps it a local relation, so later steps need no Python worker.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)


def settled(frame: DataFrame) -> DataFrame:
    """The same metric rows, computed now, so that later steps plan on plain values.

    Only for frames whose size follows the number of columns of a table.
    """
    return frame.sparkSession.createDataFrame(frame.toArrow(), schema=frame.schema)
