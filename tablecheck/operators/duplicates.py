"""Counting repeated rows without moving the whole rows that have no equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the filter that keeps rows without a repeated fingerprint out of the shuffle. It is sent
# to every task as words of 64 bits, at most half a million of them, whatever the size of the table.
FILTER_BITS = 1 << 25


def comparable(data: DataFrame) -> list[Column]:
    """Columns in a form that can be grouped; maps have no equality of their own."""
    out = []
    for field in data.schema.fields:
        nested = field.dataType.typeName() in ("map", "struct", "array", "variant")
        value = F.col(field.name)
        out.append((F.to_json(value) if nested else value).alias(field.name))
    return out


def row_fingerprint(columns: list[str]) -> list[Column]:
    """Two hashes with different seeds. NULL positions are hashed too, because hashing
    skips NULL and would otherwise confuse ``(NULL, x)`` with ``(x, NULL)``."""
    gaps = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return [
        F.xxhash64(gaps, *columns).alias("h1"),
        F.xxhash64(F.lit(7), *columns, gaps).alias("h2"),
    ]


def duplicate_rows(data: DataFrame, verify: bool = True, filter_bits: int = FILTER_BITS) -> int:
    """Rows minus distinct rows; NULLs are equal.

    Rows are counted by a 16-byte fingerprint. Equal rows always share one, so no repeated
    fingerprint proves that there are no duplicates, and only 16 bytes a row were moved. Repeated
    ones are verified on the full rows, in one plan for all sizes (:func:`candidates`).
    ``verify=False`` trusts the 128-bit fingerprint and saves that step.
    """
    rows = data.select(*comparable(data))
    repeats = F.sum(F.col("n") - 1)
    found = int(_repeated(rows).agg(repeats).first()[0] or 0)
    if not found or not verify:
        return found
    kept = candidates(rows, filter_bits).groupBy(*rows.columns).agg(F.count("*").alias("row_copies"))
    return int(kept.agg(F.sum(F.col("row_copies") - 1)).first()[0] or 0)


def _repeated(rows: DataFrame) -> DataFrame:
    keys = rows.select(*row_fingerprint(rows.columns))
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")


def candidates(rows: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose fingerprint is repeated; of the others, whole rows are not shuffled but for
    those that share a bit of the filter by chance."""
    repeated = _repeated(rows).select("h1", "h2")
    bit = F.col("h1").bitwiseAND(F.lit(filter_bits - 1))
    word, mask = F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = repeated.select(bit.alias("bit"), word).groupBy("word").agg(F.bit_or(mask).alias("bits"))
    keyed = rows.select(*row_fingerprint(rows.columns), *rows.columns)
    marked = keyed.withColumns({"bit": bit, "word": word}).join(F.broadcast(words), "word")
    passed = marked.where(F.col("bits").bitwiseAND(mask) != 0)
    # keys are unique, so this keeps rows like a semi join, which would be moved below the filter
    return passed.join(repeated, ["h1", "h2"]).select(*rows.columns)
