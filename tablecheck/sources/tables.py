"""Tables and queries of the catalog or of a database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.session import small_frame


def load_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def load_query(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """A query result. Frames given by keyword are used as ``{name}`` in the text."""
    return spark.sql(query, **frames) if frames else spark.sql(query)


def load_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    partitions: int = 200,
    **options: str,
) -> DataFrame:
    """A database table, read in parallel slices of a numeric or time column.

    Filters and columns used later are pushed into the database.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_column is None:
        return reader.option("dbtable", table).load()
    ends = f"SELECT min({partition_column}) AS low, max({partition_column}) AS high FROM {table}"
    low, high = reader.option("query", ends).load().first()
    if low is None:
        return reader.option("dbtable", table).load()
    return reader.options(
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=str(low),
        upperBound=str(high),
        numPartitions=str(partitions),
    ).load()


def load_jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def list_tables(spark: SparkSession) -> DataFrame:
    """``(name, kind, temporary)`` of the current schema."""
    rows = [
        {"name": t.name, "kind": t.tableType, "temporary": t.isTemporary}
        for t in spark.catalog.listTables()
    ]
    return small_frame(spark, rows, "name string, kind string, temporary boolean")


def table_columns(df: DataFrame) -> DataFrame:
    rows = [
        {"ordinal": i, "name": f.name, "type": f.dataType.simpleString()}
        for i, f in enumerate(df.schema.fields)
    ]
    return small_frame(df.sparkSession, rows, "ordinal int, name string, type string")


def table_info(df: DataFrame, name: str, sample_rows: int = 5) -> DataFrame:
    """One row: name, number of rows, columns with types, and a few rows as JSON."""
    spark = df.sparkSession
    sample = df.limit(sample_rows).select(F.to_json(F.struct("*")).alias("row")).collect()
    row = {
        "table_name": name,
        "row_count": df.count(),
        "columns": [r.asDict() for r in table_columns(df).collect()],
        "sample": [r.row for r in sample],
    }
    return small_frame(
        spark, [row],
        "table_name string, row_count bigint, "
        "columns array<struct<ordinal:int,name:string,type:string>>, sample array<string>",
    )
