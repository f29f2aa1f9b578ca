"""JSON documents and JSON lines as tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablecheck.functions.text import stripped
from tablecheck.session import small_frame
from tablecheck.sources.lines import decoded, file_paths, read_lines

_RAW = "_corrupt_record"


def read_json(spark: SparkSession, path) -> DataFrame:
    """One array of objects, or one object, per file; the columns are all keys seen."""
    return spark.read.option("multiLine", True).json(path)


def json_files(text: DataFrame) -> DataFrame:
    """Per file of ``(file, position, value)`` lines: does the text open with a bracket
    (``is_array``), and how it is read (``shape``).

    ``lines``: at least half of the lines that are not blank are arrays or objects by themselves;
    ``spread``: one document over many lines.
    """
    value = stripped(F.col("value"))
    first = F.min_by(F.substring(value, 1, 1), F.col("position"))
    share = F.count_if(is_container(F.col("value"))) * 2 >= F.count("*")
    return (
        text.where(value != "")
        .groupBy("file")
        .agg((first == "[").alias("is_array"), F.when(share, "lines").otherwise("spread").alias("shape"))
    )


def is_container(value: Column) -> Column:
    """Is the text one JSON array or object, and nothing after it?

    The parser ignores what follows the first value; within brackets it is a second element.
    """
    text = stripped(value)
    ends = F.concat(F.substring(text, 1, 1), F.right(text, F.lit(1)))
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    values = F.size(F.try_variant_get(inside, "$", "array<variant>"))
    return ends.isin("[]", "{}") & F.coalesce(values == 1, F.lit(False))


def read_json_files(
    spark: SparkSession, path, encoding: str = "UTF-8"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, rejects, shapes)`` of files that each have a shape of their own (:func:`json_files`).

    Files of lines are split and read by line, whether arrays or objects; a spread document is read
    by one task. Both are parsed with one schema that covers all their keys. Rejects are lines that
    are neither array nor object, and what is left of documents that break off. The work per file
    does not grow with the number of files.
    """
    text = read_lines(spark, path, encoding)
    shapes = json_files(text)
    files: dict[str, list[str]] = {"lines": [], "spread": []}
    for row in shapes.select("file", "shape").collect():  # one row per file
        files[row["shape"]].append(row["file"])
    documents, rejects = [], []
    if files["lines"]:
        # the lines listed already, as listing thousands of paths again takes a task for each
        of_lines = small_frame(spark, [{"file": f} for f in files["lines"]], "file string")
        by_line = text.join(F.broadcast(of_lines), "file", "left_semi") if files["spread"] else text
        by_line = by_line.where(stripped(F.col("value")) != "").select("value")
        documents.append(by_line.where(is_container(F.col("value"))))
        rejects.append(by_line.where(~is_container(F.col("value"))))
    if files["spread"]:
        charset = "ISO-8859-1" if encoding == "windows-1252" else encoding
        paths = file_paths(files["spread"])
        reader = spark.read.options(multiLine=True, encoding=charset, columnNameOfCorruptRecord=_RAW)
        spread = reader.schema(_spread_schema(spark, paths, charset)).json(paths)
        names = [c for c in spread.columns if c != _RAW]
        if not names:  # none of them can be read
            broken = spark.read.text(paths, wholetext=True)
            rejects.append(broken.select("value"))
        else:
            one = F.to_json(F.struct(*[f"`{c}`" for c in names]), {"ignoreNullFields": "false"})
            raw = F.col(_RAW) if _RAW in spread.columns else F.lit(None).cast("string")
            # Spark does not read the column of broken records alone
            read = spread.select(one.alias("value"), raw.alias(_RAW)).where("value is not null")
            documents.append(read.where(f"{_RAW} is null").select("value"))
            rejects.append(read.where(f"{_RAW} is not null").select(F.col(_RAW).alias("value")))
    if not documents:
        raise ValueError("Could not parse any line as a JSON object.")
    rows = parse_json_documents(reduce(DataFrame.unionByName, documents))
    return rows, reduce(DataFrame.unionByName, rejects), shapes


def _spread_schema(spark: SparkSession, paths: list[str], charset: str) -> StructType:
    """Schema of whole documents, one per file, found in all of them.

    Left to itself the reader of files finds it in one task per 128 MB, however many files these
    are, and hands the list of all paths to each of them.
    """
    whole = spark.read.text(paths, wholetext=True).select(decoded(F.col("value"), charset).alias("value"))
    reader = spark.read.options(columnNameOfCorruptRecord=_RAW)
    return reader.json(whole.rdd.map(lambda row: row["value"])).schema


def json_line_schema(lines: DataFrame) -> str:
    """Schema that covers the objects of all lines, found in one distributed pass."""
    return _merged_schema(lines.select(F.try_parse_json("value").alias("v")))


def _merged_schema(values: DataFrame) -> str:
    merged = values.where("schema_of_variant(v) like 'OBJECT<%'").agg(
        F.schema_of_variant_agg("v")
    )
    found = merged.first()[0]
    if found is None or not found.startswith("OBJECT<"):
        raise ValueError("Could not parse any line as a JSON object.")
    ddl = found.replace("OBJECT<", "STRUCT<")
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", ddl)
    return re.sub(r"\b(VOID|VARIANT)\b", "STRING", ddl)


def parse_json_lines(
    lines: DataFrame, schema: str | None = None, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``; blank lines are neither."""
    text = lines.where(stripped(F.col("value")) != "")
    schema = schema or json_line_schema(text)
    kind = F.expr("schema_of_variant(try_parse_json(value))")
    is_object = F.coalesce(kind.like("OBJECT<%"), F.lit(False))
    # as a generator, so that each record is parsed once and not once per column
    rows = F.inline(F.array(F.from_json("value", schema)))
    return text.where(is_object).select(*keep, rows), text.where(~is_object)


def parse_json_documents(
    documents: DataFrame, schema: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of whole documents in ``value``: an array gives its objects, an object one."""
    parsed = documents.withColumn("v", F.try_parse_json("value"))
    if schema is None:
        items = F.expr("try_variant_get(v, '$', 'array<variant>')")
        one = F.array(F.col("v"))
        schema = _merged_schema(parsed.select(F.explode(F.coalesce(items, one)).alias("v")))
    return parsed.select(*keep, F.inline(F.from_json("value", f"ARRAY<{schema}>")))
