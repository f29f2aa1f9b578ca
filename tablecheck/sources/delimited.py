"""Delimited text: reading, rejected rows, missing tokens, types and damaged cells."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecheck.functions.text import REPLACEMENT_CHARACTER
from tablecheck.operators.table import collect_aggregates
from tablecheck.session import small_frame
from tablecheck.sources.lines import decoded, file_paths, read_lines, read_raw_lines
from tablecheck.sources.records import records

# Cell text that means "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cell text read as true or false.
TRUE_TOKENS, FALSE_TOKENS = ("True", "TRUE", "true"), ("False", "FALSE", "false")

# Types of cells that are not just text, narrowest first.
TYPES = ("bigint", "double", "boolean")
EVERY = (1 << len(TYPES)) - 1

MAX_COLUMNS = 500
# Fixed values: (separator, encoding) tried in order when the first reading fails.
FALLBACKS = (
    (",", "UTF-8"), ("\t", "UTF-8"), (";", "UTF-8"), (",", "ISO-8859-1"), (",", "windows-1252"),
)

_NEVER = "\u0000never\u0000"
_EXTRA, _RAW = "_extra_cell", "_raw_row"

LONG_PATTERN = r"^\s*[+-]?\d+\s*$"
DOUBLE_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def read_delimited(
    spark: SparkSession,
    path,
    separator: str = ",",
    header: bool = True,
    encoding: str = "UTF-8",
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``, all cells as text, missing tokens as NULL.

    Rows with too few cells are filled up; rows with too many are rejected. Quoted cells may hold
    line breaks (``\n`` in the result, whatever the file has). Files with different names are read
    one after the other kind and united by name. Blank lines are skipped.
    """
    return united(readings(spark, path, separator, header, encoding))


@dataclass
class Reading:
    """Records of files with the same names, parsed but not yet divided into rows and rejects.

    The schema has one cell more than the table, so the parser keeps the raw text of every record
    except those with exactly one cell too many; of the others, a record is too long when it has at
    least as many separators outside quotes as the table columns.
    """

    cells: DataFrame
    names: list[str]
    separator: str
    keep: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.names))]

    @property
    def kept(self) -> list[str]:
        return [f"_{k}" for k in self.keep]

    def too_long(self) -> Column:
        bare = F.regexp_replace(F.col(_RAW), '"[^"]*"', "")
        separators = F.length(bare) - F.length(F.replace(bare, F.lit(self.separator), F.lit("")))
        return (
            F.col(_EXTRA).isNotNull() | F.col(_RAW).isNull() | (separators >= len(self.names))
        )

    def rows(self) -> DataFrame:
        good = self.cells.where(~self.too_long())
        found = good.select(*[na_to_null(F.col(k)).alias(k) for k in self.keys], *self.kept)
        return found.toDF(*self.names, *self.kept)

    def rejects(self) -> DataFrame:
        options = {"sep": self.separator, "escape": '"'}
        rebuilt = F.to_csv(F.struct(*self.keys, _EXTRA), options)
        raw = F.coalesce(F.col(_RAW), rebuilt).alias("value")
        return self.cells.where(self.too_long()).select(raw, *self.kept)

    def survey(self) -> Survey:
        """Rows, rejects, and what the cells of every column hold, in one scan."""
        cells = [na_to_null(F.col(k)) for k in self.keys]
        return _survey(self.cells, self.names, cells, self.too_long())


def united(found: list[Reading]) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of all readings, columns by name."""
    rows = [reading.rows() for reading in found]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return rows, reduce(DataFrame.unionByName, [reading.rejects() for reading in found])


def readings(
    spark: SparkSession,
    path,
    separator: str = ",",
    header: bool = True,
    encoding: str = "UTF-8",
    keep: tuple[str, ...] = (),
) -> list[Reading]:
    """One reading per set of names found in the files; ``keep`` may hold file and position."""
    found = records(read_lines(spark, path, encoding), separator)
    found = found.where(F.btrim("value") != "")
    layouts: dict[tuple, list] = {}
    for first in first_records(found).collect():  # one row per file
        layouts.setdefault(tuple(column_names(first.value, separator, header)), []).append(first)
    if not layouts:
        raise ValueError("Parsing produced an empty dataset.")
    if len(layouts) > 1:
        return [
            reading
            for files in layouts.values()
            for reading in readings(
                spark, file_paths(x.file for x in files), separator, header, encoding, keep
            )
        ]
    ((names, firsts),) = layouts.items()
    if header:
        schema = "file string, position struct<block:bigint,line:bigint>"
        heads = [{"file": x.file, "position": x.position.asDict()} for x in firsts]
        heads = F.broadcast(small_frame(spark, heads, schema))
        found = found.join(heads, ["file", "position"], "left_anti")
    return [_reading(found, list(names), separator, keep)]


def first_records(found: DataFrame) -> DataFrame:
    """``(file, position, value)`` of the first record of every file."""
    first = F.min(F.struct("position", "value")).alias("first")
    return found.groupBy("file").agg(first).select("file", "first.*")


def column_names(first: str, separator: str, header: bool) -> list[str]:
    """Names from the first record: repeated ones get ``.1``, ``.2``, empty ones their place.

    As Spark does not tell names apart by case, neither does the count of repeats.
    """
    cells = next(csv.reader([first], delimiter=separator))
    if not header:
        return [f"col_{k + 1}" for k in range(len(cells))]
    names, taken = [], set()
    for k, cell in enumerate(cells):
        name = wanted = cell or f"Unnamed: {k}"
        repeat = 0
        while name.lower() in taken:
            repeat += 1
            name = f"{wanted}.{repeat}"
        taken.add(name.lower())
        names.append(name)
    return names


def parse_delimited(
    lines: DataFrame, names: list[str], separator: str = ","
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`read_delimited` for records that are already a ``value`` column."""
    return united([_reading(lines, names, separator)])


def _reading(lines, names: list[str], separator: str, keep: tuple[str, ...] = ()) -> Reading:
    cells = F.from_csv("value", _cell_schema(names), _options(separator))
    # as a generator, so that each record is parsed once and not once per column
    kept = [F.col(k).alias(f"_{k}") for k in keep]
    return Reading(lines.select(*kept, F.inline(F.array(cells))), names, separator, keep)


def _options(separator: str) -> dict[str, str]:
    return {
        "sep": separator,
        "nullValue": _NEVER,
        "escape": '"',
        "columnNameOfCorruptRecord": _RAW,
    }


def _cell_schema(names: list[str]) -> str:
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"{len(names)} columns exceed the limit of {MAX_COLUMNS}.")
    keys = [f"c{k}" for k in range(len(names))]
    return ", ".join(f"{k} string" for k in (*keys, _EXTRA, _RAW))


def na_to_null(cell: Column) -> Column:
    return F.when(~cell.isin(*NA_TOKENS), cell)


@dataclass
class Survey:
    """What one scan tells of text cells. ``fits`` has a bit for each of TYPES that all cells of a
    column fit; it and the counts merge over any parts of the rows."""

    rows: int
    rejects: int
    cells: dict[str, int]
    fits: dict[str, int]
    damaged: dict[str, int]

    def types(self) -> dict[str, str]:
        """Narrowest type of every column; one without any value is a double."""
        return {name: self._type(name) for name in self.cells}

    def _type(self, name: str) -> str:
        if not self.cells[name]:
            return "double"
        return next((t for k, t in enumerate(TYPES) if self.fits[name] >> k & 1), "string")

    def merged(self, other: Survey) -> Survey:
        names = list(self.cells | other.cells)
        return Survey(
            self.rows + other.rows,
            self.rejects + other.rejects,
            {n: self.cells.get(n, 0) + other.cells.get(n, 0) for n in names},
            {n: self.fits.get(n, EVERY) & other.fits.get(n, EVERY) for n in names},
            {n: self.damaged.get(n, 0) + other.damaged.get(n, 0) for n in names},
        )


def _survey(rows: DataFrame, names: list[str], cells: list[Column], too_long: Column) -> Survey:
    """All columns as one long form: the plan is the same for twelve columns and for five hundred."""
    def judged(cell):
        damaged = is_damaged(cell)
        bits = [F.when(as_type(cell, t).isNotNull(), 1 << k).otherwise(0) for k, t in enumerate(TYPES)]
        fits = reduce(lambda a, b: a + b, bits)
        usable = F.when(cell.isNotNull() & ~damaged, fits)
        return F.struct(usable.alias("fits"), damaged.alias("damaged"))

    wide = rows.select(too_long.alias("bad"), F.array(*cells).alias("cells"))
    each = F.transform("cells", judged)
    # the place after the last column stands for the record itself
    whole = F.array(F.struct(F.col("bad").cast("int").alias("fits"), F.lit(False).alias("damaged")))
    none = F.filter(each, lambda x: F.lit(False))
    long = wide.select(
        F.posexplode(F.concat(F.when(~F.col("bad"), each).otherwise(none), whole)).alias("k", "x"),
        "bad",
    )
    # rejects have no cells, so their only entry stands at place 0
    place = F.when(F.col("bad"), len(names)).otherwise(F.col("k"))
    counts = long.groupBy(place.alias("k")).agg(
        F.count("*").alias("n"), F.count("x.fits").alias("cells"), F.bit_and("x.fits").alias("fits"),
        F.sum("x.fits").alias("total"), F.count_if(F.col("x.damaged")).alias("damaged"),
    )
    found = {row.k: row for row in counts.collect()}  # one row per column
    last = found.pop(len(names), None)
    rejects = last.total if last else 0
    return Survey(
        (last.n if last else 0) - rejects,
        rejects,
        {n: found[k].cells if k in found else 0 for k, n in enumerate(names)},
        {n: found[k].fits if k in found and found[k].cells else EVERY for k, n in enumerate(names)},
        {n: found[k].damaged if k in found else 0 for k, n in enumerate(names)},
    )


def infer_types(rows: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double, boolean, string per text column, in one pass.

    Dates stay text. A column without any value is a double.
    """
    cells = [F.col(f"`{c}`") for c in rows.columns]
    return _survey(rows, rows.columns, cells, F.lit(False)).types()


def as_type(cell: Column, data_type: str) -> Column:
    if data_type == "bigint":
        return F.when(cell.rlike(LONG_PATTERN), cell.try_cast("bigint"))
    if data_type == "double":
        return F.when(cell.rlike(DOUBLE_PATTERN), F.trim(cell).try_cast("double"))
    if data_type == "boolean":
        return F.when(cell.isin(*TRUE_TOKENS), True).when(cell.isin(*FALSE_TOKENS), False)
    return cell


def typed(rows: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns cast to their inferred types."""
    types = types or infer_types(rows)
    return rows.select(
        *[as_type(F.col(f"`{n}`"), types[n]).alias(n) for n in rows.columns]
    )


# ------------------------------------------------------------------ damaged cells


def _text_columns(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]


def is_damaged(cell: Column) -> Column:
    return F.coalesce(cell.contains(REPLACEMENT_CHARACTER), F.lit(False))


def without_damaged_cells(rows: DataFrame) -> DataFrame:
    """Cells that could not be decoded become NULL; no row is dropped."""
    text = set(_text_columns(rows))
    cells = [F.col(f"`{c}`") for c in rows.columns]
    return rows.select(
        *[
            (F.when(~is_damaged(v), v) if c in text else v).alias(c)
            for c, v in zip(rows.columns, cells)
        ]
    )


def damaged_cell_counts(rows: DataFrame) -> DataFrame:
    """``(column, damaged)`` for text columns with damaged cells."""
    wanted = {c: F.count_if(is_damaged(F.col(f"`{c}`"))) for c in _text_columns(rows)}
    counts = collect_aggregates(rows, wanted)
    found = [{"column": c, "damaged": n} for c, n in counts.items() if n]
    return small_frame(rows.sparkSession, found, "column string, damaged bigint")


def damaged_row_sample(
    rows: DataFrame, order_by: str, per_column: int = 5, limit: int = 20
) -> DataFrame:
    """Order keys of the first rows with damaged cells, five per column, twenty in all."""
    found = [
        rows.where(is_damaged(F.col(f"`{c}`")))
        .select(F.lit(c).alias("column"), F.col(order_by).alias("key"))
        .orderBy("key")
        .limit(per_column)
        for c in _text_columns(rows)
    ]
    if not found:
        return small_frame(rows.sparkSession, [], "key string")
    keys = reduce(DataFrame.unionByName, found).select("key").distinct()
    return keys.orderBy("key").limit(limit)


def damaged_places(rows: DataFrame, names: list[str], per_column: int, limit: int) -> list:
    """``(file, position)`` of the first rows with damaged cells, some per column; one scan of rows
    that carry their place (:func:`readings`)."""
    hit = [F.when(is_damaged(F.col(f"`{c}`")), F.lit(k)) for k, c in enumerate(names)]
    marked = rows.select("_file", "_position", F.array_compact(F.array(*hit)).alias("hit"))
    long = marked.select(
        F.col("_file").alias("file"), F.col("_position").alias("position"), F.explode("hit").alias("k")
    )
    order = Window.partitionBy("k").orderBy("file", "position")
    first = long.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_column)
    return first.select("file", "position").distinct().orderBy("file", "position").limit(limit).collect()


# ------------------------------------------------------------------ fallback


def rank_fallbacks(spark: SparkSession, path) -> DataFrame:
    """Every fallback reading with its width, rejected records and damaged lines, best first.

    All readings are judged in two scans over the raw lines, each reading a few aggregates: the
    width of the first record, then how many lines are wider or hold text that the encoding cannot
    read. More than one column beats one; then fewer damaged lines, then fewer rejects, then the
    order of :data:`FALLBACKS`.
    """
    raw = read_raw_lines(spark, path)
    raw = raw.where(F.btrim(decoded(F.col("value"), "ISO-8859-1")) != "")
    width, damaged = [], []
    for separator, encoding in FALLBACKS:
        text = decoded(F.col("value"), encoding)
        bare = F.regexp_replace(text, '"[^"]*"', "")
        width.append(F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1)
        damaged.append(is_damaged(text))
    places = range(len(FALLBACKS))
    by_file = raw.groupBy("file").agg(
        F.min(F.struct("position", F.array(*width).alias("width")))["width"].alias("width")
    )
    # files of one folder may differ; the narrowest one speaks for a reading
    widths = by_file.agg(*[F.min(F.col("width")[k]).alias(f"w{k}") for k in places]).first()
    if widths.w0 is None:
        raise ValueError("Parsing produced an empty dataset.")
    counts = raw.agg(
        *[F.count_if(width[k] > widths[k]).alias(f"r{k}") for k in places],
        *[F.count_if(damaged[k]).alias(f"d{k}") for k in places],
    ).first()
    found = [
        {
            "place": k, "separator": FALLBACKS[k][0], "encoding": FALLBACKS[k][1],
            "columns": widths[k], "rejects": counts[f"r{k}"], "damaged": counts[f"d{k}"],
        }
        for k in places
    ]
    found.sort(
        key=lambda r: (r["columns"] < 2, r["damaged"], r["rejects"], r["place"])
    )
    return small_frame(
        spark, found,
        "place int, separator string, encoding string, columns int, "
        "rejects bigint, damaged bigint",
    )
