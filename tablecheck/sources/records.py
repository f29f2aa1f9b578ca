"""Delimited records from text lines, where quoted cells may hold line breaks.

Reading stays split by blocks of a file. A quoted cell that is open at the end of a line goes on in
the next line, so a line is a step between two states, inside and outside of quotes, and so is a
block. One scan finds the step of every block, a running composition over the blocks of a file tells
in which state each block starts, and a second scan joins the lines of a record. Only records that
cross the border of two blocks are moved: their pieces, two per block at most, are put together.

A quote counts where a cell starts with it. A file that ends inside of quotes has a stray quote; its
lines are taken as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BLOCKS = 200_000  # blocks that start inside of quotes and are sent to all tasks

PIECES = (
    "file string, position struct<block:bigint,line:bigint>, value string, opens boolean, closes boolean"
)


class Quotes:
    """Where a line leaves off: inside of quotes or outside."""

    def __init__(self, separator: str):
        s = re.escape(separator)
        self.cells = re.compile(rf'(?:(?:"(?:[^"]|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+')
        self.closing = re.compile(rf'(?:[^"]|"")*+"[^{s}]*+(?:{s}|$)', re.DOTALL)
        self.open_cell = re.compile(r'"(?:[^"]|"")*+$', re.DOTALL)

    def after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        start = 0
        if inside:
            found = self.closing.match(line)
            if found is None:
                return True
            start = found.end()
            if line[start - 1 : start] == '"' or start == len(line):
                return False
        start = self.cells.match(line, start).end()
        return self.open_cell.match(line, start) is not None


def _steps(batches, separator: str) -> Iterator[pa.RecordBatch]:
    """Per block: the state at its end when it starts outside, or inside, of quotes."""
    quotes, blocks = Quotes(separator), {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "value")]
        for file, block, line in zip(*columns):
            outside, inside = blocks.get((file, block), (False, True))
            blocks[file, block] = quotes.after(line, outside), quotes.after(line, inside)
    keys = list(blocks)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
            pa.array([blocks[k][0] for k in keys], pa.bool_()),
            pa.array([blocks[k][1] for k in keys], pa.bool_()),
        ],
        names=["file", "block", "from_outside", "from_inside"],
    )


def _broken(batches, separator: str) -> Iterator[pa.RecordBatch]:
    """Whether a line may leave a quoted cell open, one row per task."""
    quotes, found = Quotes(separator), False
    for batch in batches:
        found = found or any(quotes.after(x, False) for x in batch.column("value").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([found])], names=["broken"])


def _joined(batches, separator: str) -> Iterator[pa.RecordBatch]:
    """Records, and the pieces of those that cross the borders of a block, in the order of lines."""
    quotes = Quotes(separator)
    at, inside, parts, first, opened = None, False, [], None, True

    def piece(closes):
        return at[0], {"block": at[1], "line": first}, "\n".join(parts), opened, closes

    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "line", "value", "start")]
        for file, block, line, value, start in zip(*columns):
            if (file, block) != at:
                if parts:
                    rows.append(piece(False))
                at, inside, parts, opened = (file, block), bool(start), [], not start
            if not parts:
                first = line
            parts.append(value)
            inside = quotes.after(value, inside)
            if not inside:
                rows.append(piece(True))
                parts, opened = [], True
        yield _table(rows)
    if parts:
        yield _table([piece(False)])


def _table(rows) -> pa.RecordBatch:
    kinds = (
        ("file", pa.string()),
        ("position", pa.struct([("block", pa.int64()), ("line", pa.int64())])),
        ("value", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_()),
    )
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], names=[n for n, _ in kinds]
    )


def block_starts(lines: DataFrame, separator: str) -> DataFrame:
    """``(file, block, inside, stray)`` for every block: does it start inside of quotes, and does the
    file end there?"""
    flat = lines.select("file", "position.block", "value")
    quoted = flat.where(F.col("value").contains('"')).mapInArrow(
        lambda batches: _steps(batches, separator),
        "file string, block bigint, from_outside boolean, from_inside boolean",
    )
    plain = flat.select("file", "block", F.lit(False), F.lit(True)).distinct()
    steps = quoted.union(plain).groupBy("file", "block").agg(
        # of a block's own step and the step that changes nothing, the own one
        F.max("from_outside").alias("from_outside"), F.min("from_inside").alias("from_inside")
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("from_outside") == F.col("from_inside")
    turns = F.col("from_outside") & ~F.col("from_inside")
    counted = steps.withColumn("turns", F.sum(turns.cast("int")).over(order)).withColumn(
        "settled", F.when(settles, F.struct(F.col("from_outside").cast("int").alias("state"), "turns"))
    )
    last = F.last("settled", ignorenulls=True).over(before)
    state = F.coalesce(last["state"], F.lit(0)) + (
        F.coalesce(F.lag("turns").over(order), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    )
    placed = counted.withColumn("inside", state % 2 == 1)
    end = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    stray = F.max_by(end, F.col("block")).over(Window.partitionBy("file"))
    return placed.select("file", "block", "inside", stray.alias("stray"))


def has_line_breaks(lines: DataFrame, separator: str) -> bool:
    """Does any line, taken by itself, leave a quoted cell open?"""
    quoted = lines.where(F.col("value").contains('"')).select("value")
    found = quoted.mapInArrow(lambda batches: _broken(batches, separator), "broken boolean")
    return bool(found.agg(F.max("broken")).first()[0])


def records(lines: DataFrame, separator: str = ",") -> DataFrame:
    """``(file, position, value)`` of records, from lines in the order in which they are read."""
    if not has_line_breaks(lines, separator):
        return lines.select("file", "position", "value")
    odd = block_starts(lines, separator).where("inside or stray")
    some = odd.agg(F.count("*").alias("blocks"), F.count_if(F.col("stray")).alias("stray")).first()
    marked = lines.select("file", "position.block", "position.line", "value")
    if not some.blocks:  # all records lie within their blocks
        return _pieces(marked.withColumn("start", F.lit(False)), separator).drop("opens", "closes")
    few = some.blocks <= BROADCAST_BLOCKS
    marked = marked.join(F.broadcast(odd) if few else odd, ["file", "block"], "left")
    if not few:
        marked = marked.repartition("file", "block").sortWithinPartitions("file", "block", "line")
    start = F.coalesce("inside", F.lit(False)).alias("start")
    rest = marked.where("stray is null or not stray")
    pieces = _pieces(rest.select("file", "block", "line", "value", start), separator)
    whole = pieces.where("opens and closes").select("file", "position", "value")
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("position"))
    parts = F.array_sort(F.collect_list(F.struct("position", "value")))
    crossing = (
        pieces.where("not (opens and closes)")
        .withColumn("number", number)
        .groupBy("file", "number")
        .agg(
            F.min("position").alias("position"),
            F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"),
        )
        .select("file", "position", "value")
    )
    found = whole.unionByName(crossing)
    if some.stray:
        position = F.struct("block", "line").alias("position")
        found = found.unionByName(marked.where("stray").select("file", position, "value"))
    return found


def _pieces(marked: DataFrame, separator: str) -> DataFrame:
    return marked.mapInArrow(lambda batches: _joined(batches, separator), PIECES)
