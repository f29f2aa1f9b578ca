"""Exact order statistics without sorting the data and without one big group.

A bounded random sample suggests a narrow bracket around every wanted rank. A full
scan then counts exactly how many values lie below and inside each bracket; only the
values inside are grouped and fetched. A bracket that misses its rank or still holds
too many values is narrowed again, so the answer never depends on the sample. Later
rounds read only the values that are still in brackets, not the whole data again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most distinct values fetched by one job, over all columns together.
FETCH_BUDGET = 1_000_000
SAMPLE_ROWS = 400_000

# Points where a bracket, or all brackets of a column, are cut when a sample tells no more.
CUTS = 15
# Values in brackets are kept between rounds when they are at most this share of those read before.
KEPT_SHARE = 0.25


@dataclass
class Bracket:
    low: float
    high: float
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)


def quantile_ranks(count: int, probabilities) -> dict[float, tuple[int, int, float]]:
    """For each probability the two neighbouring ranks and the weight of the upper one."""
    out = {}
    for p in probabilities:
        position = (count - 1) * p
        low = math.floor(position)
        out[p] = (low, min(low + 1, count - 1), position - low)
    return out


def interpolate(low: float, high: float, weight: float) -> float:
    if low == high:
        return low
    step = high - low
    return high - step * (1 - weight) if weight >= 0.5 else low + step * weight


def order_statistics(
    values: DataFrame,
    counts: dict[int, int],
    ranks: dict[int, set[int]],
    fetch_budget: int = FETCH_BUDGET,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[int, dict[int, float]]:
    """Values at 0-based ranks. ``values`` is ``(i int, x double)`` without NULL."""
    found: dict[int, dict[int, float]] = {i: {} for i in ranks}
    open_brackets = {
        i: [Bracket(-math.inf, math.inf, 0, counts[i], sorted(wanted))]
        for i, wanted in ranks.items()
        if wanted
    }
    kept, read = None, sum(counts[i] for i in open_brackets)
    rounds = 0
    while open_brackets:
        total = sum(b.inside for group in open_brackets.values() for b in group)
        if total > fetch_budget:
            if total <= read * KEPT_SHARE:
                inner = _in_play(values, open_brackets).select("i", "x")
                values = inner.persist(StorageLevel.MEMORY_AND_DISK)
                # the copy before goes when this one is made, which reads it
                before, kept, read = kept, values, total
            else:
                before = None
            parts, expected = _narrowed(values, open_brackets, total, sample_rows, rounds)
            if before is not None:
                before.unpersist()
        else:
            parts = {
                i: [[Bracket(b.low, b.high, 0, 0, b.ranks)] for b in group]
                for i, group in open_brackets.items()
            }
            expected = total
        fetch = expected <= fetch_budget
        zones, members = _scan(values, open_brackets, parts, fetch, fetch_budget)
        open_brackets = _advance(open_brackets, parts, zones, members, found)
        rounds += 1
    if kept is not None:
        kept.unpersist()
    return found


def whole_order_statistics(keys: DataFrame, rows: int, ranks: set[int]) -> dict[int, int]:
    """Whole numbers ``x`` at 0-based ranks, exact over the whole range of bigint.

    Rounding to doubles keeps the order, so the double at a rank is found first. Beyond 2^53 several
    numbers may round to it; these differ by little, and the rank among them is found by their
    exact distances from one of them.
    """
    near = order_statistics(
        keys.select(F.lit(0).alias("i"), F.col("x").cast("double").alias("x")), {0: rows}, {0: ranks}
    )[0]
    found = {r: int(x) for r, x in near.items() if abs(x) < 2**53}
    classes = sorted({x for x in near.values() if abs(x) >= 2**53})
    if not classes:
        return found
    rounded = F.col("x").cast("double")
    counts = keys.agg(
        *[F.count_if(rounded < x).alias(f"b{k}") for k, x in enumerate(classes)],
        *[F.count_if(rounded == x).alias(f"n{k}") for k, x in enumerate(classes)],
        *[F.min(F.when(rounded == x, F.col("x"))).alias(f"m{k}") for k, x in enumerate(classes)],
    ).first()
    place, base = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k, x in enumerate(classes):
        place = F.when(rounded == x, k).otherwise(place)
        base = F.when(rounded == x, counts[f"m{k}"]).otherwise(base)
    apart = keys.select(place.alias("i"), (F.col("x") - base).cast("double").alias("x"))
    inner = {k: {} for k in range(len(classes))}
    for r, x in near.items():
        if abs(x) >= 2**53:
            k = classes.index(x)
            inner[k][r - counts[f"b{k}"]] = r
    exact = order_statistics(
        apart.where("i is not null"),
        {k: counts[f"n{k}"] for k in inner}, {k: set(wanted) for k, wanted in inner.items()},
    )
    for k, wanted in inner.items():
        found |= {r: counts[f"m{k}"] + int(exact[k][place]) for place, r in wanted.items()}
    return found


def _zone(brackets: dict[int, list[Bracket]]) -> Column:
    """Odd inside bracket ``(zone - 1) / 2``, even in a gap; one number per value."""
    size = max(brackets) + 1
    zone = F.lit(0)
    for j in range(max(len(group) for group in brackets.values())):
        # NaN sorts above everything in Spark, so a missing bracket is never reached
        lows, highs = [math.nan] * size, [math.nan] * size
        for i, group in brackets.items():
            if j < len(group):
                lows[i], highs[i] = float(group[j].low), float(group[j].high)
        zone = zone + F.when(F.col("x") >= F.get(F.lit(lows), F.col("i")), 1).otherwise(0)
        zone = zone + F.when(F.col("x") > F.get(F.lit(highs), F.col("i")), 1).otherwise(0)
    return zone


def _in_play(values: DataFrame, brackets: dict[int, list[Bracket]]) -> DataFrame:
    """Values within the open brackets; ``b`` is the bracket of each."""
    chosen = values.where(F.col("i").isin(*sorted(brackets)))
    zoned = chosen.withColumn("z", _zone(brackets)).where(F.col("z") % 2 == 1)
    return zoned.select("i", "x", F.expr("(z - 1) div 2").cast("int").alias("b"))


def _narrowed(values, brackets, total, sample_rows, seed):
    """For every bracket the narrower ones that a sample of its values suggests, and how
    many distinct values they may hold. None of them is as wide as its origin."""
    fraction = min(1.0, sample_rows / total)
    sample = _in_play(values, brackets).where(F.rand(17 + seed) < fraction).toArrow()
    i_column, b_column, x_column = (sample.column(n).to_numpy() for n in ("i", "b", "x"))
    parts: dict[int, list[list[Bracket]]] = {}
    expected = 0.0
    for i, group in brackets.items():
        parts[i] = []
        for j, b in enumerate(group):
            points = np.sort(x_column[(i_column == i) & (b_column == j)])
            narrow = _suggested(points, b, max(1, CUTS // len(group)))
            parts[i].append(narrow)
            for n in narrow:
                seen = points[(points >= n.low) & (points <= n.high)]
                distinct = len(np.unique(seen))
                scaled = b.inside * (len(seen) + 1) / max(len(points), 1)
                # few distinct values in a sample mean that most of them were seen
                expected += min(scaled, 4.0 * distinct + 4 if 2 * distinct < len(seen) else scaled)
    return parts, expected


def _suggested(points: np.ndarray, b: Bracket, cuts: int) -> list[Bracket]:
    """Narrow brackets around the ranks; a sample too small for these gives evenly spread cuts."""
    m = len(points)
    if not m:
        return [Bracket(b.low, b.high, 0, 0, b.ranks)]
    spans = []
    for rank in b.ranks:
        q = (rank - b.below + 0.5) / b.inside
        margin = 5 * math.sqrt(q * (1 - q) / m) + 5 / m
        first, last = math.floor((q - margin) * m), math.ceil((q + margin) * m)
        low = float(points[first]) if first >= 0 else b.low
        high = float(points[last]) if last < m else b.high
        spans.append((low, high, rank))
    merged: list[Bracket] = []
    for low, high, rank in sorted(spans):
        if merged and low <= merged[-1].high:
            merged[-1].high = max(merged[-1].high, high)
            merged[-1].ranks.append(rank)
        else:
            merged.append(Bracket(low, high, 0, 0, [rank]))
    inside = sum(np.count_nonzero((points >= n.low) & (points <= n.high)) for n in merged)
    places = 1 + sum(after - rank > 1 for rank, after in zip(b.ranks, b.ranks[1:]))
    stuck = len(merged) == 1 and (merged[0].low, merged[0].high) == (b.low, b.high)
    if stuck or inside * (cuts + 1) > m * places:
        # the ranks lie in no more than as many of the gaps between cuts, which hold fewer values;
        # a frequent value is a cut of its own, there it is resolved or excluded
        at = np.unique(points[np.arange(1, cuts + 1) * m // (cuts + 1)])
        return [Bracket(float(x), float(x), 0, 0, b.ranks) for x in at]
    return merged


def _scan(values, brackets, parts, fetch, fetch_budget):
    """Exact counts per bracket and zone, and the members of the parts when they fit."""
    flat = {i: [p for narrow in groups for p in narrow] for i, groups in parts.items()}
    zoned = _in_play(values, brackets).withColumn("z", _zone(flat))
    if fetch:
        member = F.when(F.col("z") % 2 == 1, F.col("x"))
        rows = zoned.groupBy("i", "b", "z", member.alias("x")).agg(F.count("*").alias("n"))
        table = rows.limit(2 * fetch_budget + 1).toArrow()
        if table.num_rows <= 2 * fetch_budget:
            zones: dict = {}
            members: dict = {}
            for (i, b, z), part in table.to_pandas().groupby(["i", "b", "z"], sort=False):
                zones[(i, b, z)] = int(part["n"].sum())
                if z % 2 == 1:
                    part = part.sort_values("x")
                    members[(i, b, z)] = (part["x"].to_numpy(), part["n"].to_numpy().cumsum())
            return zones, members
    counted = zoned.groupBy("i", "b", "z").agg(F.count("*").alias("n")).collect()
    return {(r.i, r.b, r.z): r.n for r in counted}, {}


def _advance(previous, parts, zones, members, found):
    """Resolve ranks whose value is known; keep exact, narrower brackets for the rest."""
    remaining: dict[int, list[Bracket]] = {}
    for i, group in previous.items():
        offset = 0
        for j, b in enumerate(group):
            # every zone of this bracket in value order, with the closed interval it covers
            spans = []
            below, edge = b.below, b.low
            for k, part in enumerate(parts[i][j], start=offset):
                gap = zones.get((i, j, 2 * k), 0)
                spans.append((edge, np.nextafter(part.low, -math.inf), below, gap, 2 * k))
                below += gap
                size = zones.get((i, j, 2 * k + 1), 0)
                spans.append((part.low, part.high, below, size, 2 * k + 1))
                below += size
                edge = np.nextafter(part.high, math.inf)
            offset += len(parts[i][j])
            tail = zones.get((i, j, 2 * offset), 0)
            spans.append((edge, b.high, below, tail, 2 * offset))
            for low, high, start, size, zone in spans:
                inside = [r for r in b.ranks if start <= r < start + size]
                if not inside:
                    continue
                if low == high:
                    found[i].update({r: float(low) for r in inside})
                elif (i, j, zone) in members:
                    xs, running = members[(i, j, zone)]
                    for r in inside:
                        at = int(np.searchsorted(running, r - start, side="right"))
                        found[i][r] = float(xs[at])
                else:
                    bracket = Bracket(float(low), float(high), start, size, sorted(inside))
                    remaining.setdefault(i, []).append(bracket)
    return remaining
