"""Passes over pairs of columns: correlation sums and common missing values."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.operators.table import AGGREGATES_PER_JOB, merged

# Up to this many columns the sums are plain aggregates; beyond, blocks of a Gram matrix.
WIDE_SUM_COLUMNS = 12
MASK_BITS = 60

PAIR_FIELDS = ("n", "sum_a", "sum_b", "square_a", "square_b", "product")


def bit_masks(flags: dict[int, Column]) -> list[Column]:
    """One bit per true flag, packed into as few longs as needed."""
    ordinals = list(flags)
    masks = []
    for start in range(0, len(ordinals), MASK_BITS):
        mask = F.lit(0).cast("bigint")
        for bit, i in enumerate(ordinals[start:start + MASK_BITS]):
            mask = mask + F.when(flags[i], 1 << bit).otherwise(0).cast("bigint")
        masks.append(mask)
    return masks


def pair_sums(
    centred: DataFrame, ordinals: list[int], wide_sum_columns: int = WIDE_SUM_COLUMNS
) -> dict:
    """``(i, j) -> sums over rows where both are present`` for all ``i < j``.

    ``centred`` has one double column ``v<i>`` per ordinal, shifted by its mean so that
    sums of squares keep their precision.
    """
    if len(ordinals) < 2:
        return {}
    if len(ordinals) <= wide_sum_columns:
        return _sums_by_null_pattern(centred, ordinals)
    return _sums_by_gram_blocks(centred, ordinals)


def _sums_by_null_pattern(centred, ordinals):
    """Rows with one null pattern are complete on its columns, so plain sums suffice."""
    value = {i: F.coalesce(F.col(f"v{i}"), F.lit(0.0)) for i in ordinals}
    present = {i: F.col(f"v{i}").isNotNull() for i in ordinals}
    [mask] = bit_masks(present)
    wanted = {("n",): F.count("*")}
    for i in ordinals:
        wanted[("s", i)] = F.sum(value[i])
        wanted[("q", i)] = F.sum(value[i] * value[i])
    for i, j in combinations(ordinals, 2):
        wanted[("p", i, j)] = F.sum(value[i] * value[j])
    items = list(wanted.items())
    chunks = [
        items[k:k + AGGREGATES_PER_JOB] for k in range(0, len(items), AGGREGATES_PER_JOB)
    ]
    by_mask = centred.withColumn("mask", mask).groupBy("mask")

    def run(chunk):
        rows = by_mask.agg(*[e.alias(f"a{k}") for k, (_, e) in enumerate(chunk)]).collect()
        return {
            (row["mask"], key): row[f"a{k}"]
            for row in rows
            for k, (key, _) in enumerate(chunk)
        }

    sums = merged(run, chunks)
    masks = {m for m, _ in sums}
    bit = {i: 1 << b for b, i in enumerate(ordinals)}
    result = {}
    for i, j in combinations(ordinals, 2):
        both = [m for m in masks if m & bit[i] and m & bit[j]]
        keys = [("n",), ("s", i), ("s", j), ("q", i), ("q", j), ("p", i, j)]
        totals = [math.fsum(sums[(m, key)] for m in both) for key in keys]
        result[(i, j)] = dict(zip(PAIR_FIELDS, totals))
    return result


def _sums_by_gram_blocks(centred, ordinals):
    """Each task multiplies its Arrow batches into one small block; blocks are added up."""
    columns = [f"v{i}" for i in ordinals]

    def block(batches):
        total = None
        for batch in batches:
            data = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]
            )
            present = ~np.isnan(data)
            data = np.where(present, data, 0.0)
            shown = present.astype("float64")
            part = np.stack(
                [shown.T @ shown, data.T @ shown, (data * data).T @ shown, data.T @ data]
            )
            total = part if total is None else total + part
        if total is None:
            return
        a, b = np.triu_indices(len(columns), 1)
        count, line, square, product = total
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a.astype("int32")),
                pa.array(b.astype("int32")),
                *[
                    pa.array(m)
                    for m in (
                        count[a, b], line[a, b], line[b, a],
                        square[a, b], square[b, a], product[a, b],
                    )
                ],
            ],
            names=["a", "b", *PAIR_FIELDS],
        )

    schema = "a int, b int, " + ", ".join(f"{f} double" for f in PAIR_FIELDS)
    blocks = centred.select(*columns).mapInArrow(block, schema)
    rows = blocks.groupBy("a", "b").agg(*[F.sum(f).alias(f) for f in PAIR_FIELDS]).collect()
    return {
        (ordinals[r.a], ordinals[r.b]): {f: r[f] for f in PAIR_FIELDS} for r in rows
    }


def pearson(sums: dict) -> float | None:
    """Correlation from centred sums; None when either side does not vary."""
    n = sums["n"]
    if n < 2:
        return None
    variances = []
    for side in "ab":
        square = sums[f"square_{side}"]
        variance = square - sums[f"sum_{side}"] ** 2 / n
        if not variance > 1e-13 * square:
            return None
        variances.append(variance)
    covariance = sums["product"] - sums["sum_a"] * sums["sum_b"] / n
    r = covariance / math.sqrt(variances[0] * variances[1])
    return None if math.isnan(r) else max(-1.0, min(1.0, r))


def co_missing_counts(data: DataFrame, missing: dict[int, Column]) -> dict:
    """``(i, j) -> rows where both are missing``; counts each missing pattern once."""
    if len(missing) < 2:
        return {}
    ordinals = list(missing)
    masks = [m.alias(f"m{k}") for k, m in enumerate(bit_masks(missing))]
    names = [f"m{k}" for k in range(len(masks))]
    patterns = data.select(*masks).groupBy(*names).agg(F.count("*").alias("n"))
    position = F.sequence(F.lit(0), F.lit(len(ordinals) - 1))
    words = F.array(*names)

    def is_set(p):
        word = F.get(words, F.floor(p / MASK_BITS).cast("int"))
        bit = F.get(F.lit([1 << b for b in range(MASK_BITS)]), p % MASK_BITS)
        return word.bitwiseAND(bit) != 0

    gaps = patterns.select("n", F.filter(position, is_set).alias("gaps")).where(
        F.size("gaps") > 1
    )
    pairs = (
        gaps.select("n", "gaps", F.explode("gaps").alias("i"))
        .select("n", "i", F.explode("gaps").alias("j"))
        .where("i < j")
        .groupBy("i", "j")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return {(ordinals[r.i], ordinals[r.j]): int(r.n) for r in pairs}
