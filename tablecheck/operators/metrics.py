"""All metrics of one table; each pass over the data runs once, when first needed.

===========  ==========================================================  ==========
pass         what it reads                                               data moved
===========  ==========================================================  ==========
counts       every column: present values, range, mean, zeros            1 row/task
moments      numeric columns around their mean                           1 row/task
pairs        numeric columns around their mean, products per pair        1 row/task
quartiles    numeric columns: sample, then exact counts around ranks     bracketed values
outliers     numeric columns against known bounds                        1 row/task
histograms   numeric columns against known edges                         20 rows/column/task
frequencies  text columns: value counts                                  distinct values
distinct     other columns: distinct 8-byte hashes                       distinct values
duplicates   whole rows as fingerprints, candidates as rows              16 bytes/row
===========  ==========================================================  ==========
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.operators import duplicates, frequencies, histograms, ranks, relations
from tablecheck.operators.table import (
    BOOLEAN,
    NUMERIC,
    OPAQUE,
    TEXT,
    TIME,
    ColumnInfo,
    collect_aggregates,
    describe_columns,
    prepared,
    side_by_side,
    spread_if_small,
    stacked,
)

QUARTILES = (0.25, 0.5, 0.75)

# Passes that may run side by side; within a chain the later ones use the earlier ones.
RULE_CHAINS = (("_frequencies",), ("_fixed_distinct",), ("duplicate_rows",))
PROFILE_CHAINS = (("_quartiles", "_outliers"), ("_moments",), *RULE_CHAINS)
STATISTIC_CHAINS = (("_pair_sums",), ("histograms",), ("co_missing",))
RANK_COLUMNS_PER_JOB = 64


def half_even(value: float | None, digits: int) -> float | None:
    """Same rounding as :func:`tablecheck.functions.numeric.round_even`."""
    if value is None:
        return None
    scale = 10.0 ** digits
    return float(np.rint(value * scale) / scale)


def share(part: float, whole: float, digits: int = 2) -> float | None:
    return half_even(part / whole * 100.0, digits) if whole else None


def finite(value: float | None) -> float | None:
    if value is None or not math.isfinite(value):
        return None
    return float(value)


class TableMetrics:
    """Lazily computed metrics of one DataFrame.

    ``approx_distinct`` replaces exact distinct counts by HyperLogLog estimates.
    ``verify_duplicates=False`` trusts 128-bit row fingerprints on large tables.
    ``spread=False`` never keeps a small input in memory between passes.
    ``wide_sum_columns`` is the number of numeric columns up to which correlations use
    plain aggregates.
    """

    def __init__(
        self,
        df: DataFrame,
        approx_distinct: bool = False,
        verify_duplicates: bool = True,
        spread: bool = True,
        wide_sum_columns: int = relations.WIDE_SUM_COLUMNS,
    ):
        self.spark = df.sparkSession
        self.columns = describe_columns(df)
        self.approx_distinct = approx_distinct
        self.verify_duplicates = verify_duplicates
        self.source = df
        self._spread = spread
        self._wide_sum_columns = wide_sum_columns

    # ------------------------------------------------------------ inputs

    @cached_property
    def data(self) -> DataFrame:
        data = prepared(self.source, self.columns)
        if not self._spread:
            return data
        data, self._kept = spread_if_small(data)
        return data

    def release(self) -> None:
        """Drop the copy of a small input that was kept between passes."""
        if getattr(self, "_kept", False):
            self.data.unpersist()

    def of_kind(self, *kinds: str) -> list[ColumnInfo]:
        return [c for c in self.columns if c.kind in kinds]

    @property
    def numeric(self) -> list[ColumnInfo]:
        return self.of_kind(NUMERIC)

    def column(self, name: str) -> ColumnInfo | None:
        return next((c for c in self.columns if c.name == name), None)

    def prefetch(self, chains=PROFILE_CHAINS + STATISTIC_CHAINS) -> "TableMetrics":
        """Run independent passes at the same time, which keeps a cluster busy."""
        open_chains = [
            [name for name in chain if name not in self.__dict__] for chain in chains
        ]
        side_by_side(
            [lambda c=c: [getattr(self, name) for name in c] for c in open_chains if c],
            first=lambda: self.row_count,
        )
        return self

    # ------------------------------------------------------------ one-row passes

    @cached_property
    def _counts(self) -> dict:
        wanted: dict = {}
        for c in self.columns:
            value = F.col(c.key)
            wanted[(c.ordinal, "count")] = F.count(value)
            if c.kind in (NUMERIC, TEXT, TIME):
                wanted[(c.ordinal, "smallest")] = F.min(value)
            if c.kind == NUMERIC:
                wanted[(c.ordinal, "mean")] = F.avg(c.number())
                wanted[(c.ordinal, "max")] = F.max(value).cast("double")
                wanted[(c.ordinal, "zeros")] = F.count_if(value == 0)
            elif c.kind == BOOLEAN:
                wanted[(c.ordinal, "true")] = F.count_if(value)
        wanted["rows"] = F.count("*")
        return collect_aggregates(self.data, wanted)

    @property
    def row_count(self) -> int:
        return self._counts["rows"]

    def count(self, c: ColumnInfo) -> int:
        return self._counts[(c.ordinal, "count")]

    def missing(self, c: ColumnInfo) -> int:
        return self.row_count - self.count(c)

    def missing_pct(self, c: ColumnInfo) -> float | None:
        return share(self.missing(c), self.row_count)

    def value(self, c: ColumnInfo, metric: str):
        if metric == "min":
            low = self._counts[(c.ordinal, "smallest")]
            return None if low is None else float(low)
        return self._counts[(c.ordinal, metric)]

    def is_flat(self, c: ColumnInfo) -> bool:
        return self.value(c, "min") == self.value(c, "max")

    def _centred(self, c: ColumnInfo) -> Column:
        # a flat column must give exact zeros, its mean may be off by one ulp
        centre = self.value(c, "min") if self.is_flat(c) else self.value(c, "mean")
        return c.number() - F.lit(float(centre))

    @property
    def _shaped(self) -> list[ColumnInfo]:
        """Numeric columns with values and a finite mean."""
        return [
            c for c in self.numeric
            if self.count(c) and math.isfinite(self.value(c, "mean"))
        ]

    @cached_property
    def _moments(self) -> dict:
        wanted: dict = {}
        for c in self._shaped:
            if self.is_flat(c):
                continue
            d = self._centred(c)
            wanted[(c.ordinal, 2)] = F.sum(d * d)
            wanted[(c.ordinal, 3)] = F.sum(d * d * d)
            wanted[(c.ordinal, 4)] = F.sum(d * d * (d * d))
        return collect_aggregates(self.data, wanted)

    def _moment(self, c: ColumnInfo, power: int) -> float:
        return self._moments.get((c.ordinal, power), 0.0)

    def mean(self, c: ColumnInfo) -> float | None:
        if self.count(c) and self.is_flat(c):
            return finite(self.value(c, "min"))
        return finite(self.value(c, "mean"))

    def std(self, c: ColumnInfo) -> float | None:
        n = self.count(c)
        if n < 2 or c not in self._shaped:
            return None
        return math.sqrt(self._moment(c, 2) / (n - 1))

    def skewness(self, c: ColumnInfo) -> float | None:
        """Bias-corrected; 0 when constant, None below three values."""
        n = self.count(c)
        if n < 3 or c not in self._shaped:
            return None
        m2, m3 = self._moment(c, 2), self._moment(c, 3)
        if m2 < 1e-14:
            return 0.0
        return n * math.sqrt(n - 1) / (n - 2) * m3 / m2 ** 1.5

    def kurtosis(self, c: ColumnInfo) -> float | None:
        """Bias-corrected excess; 0 when constant, None below four values."""
        n = self.count(c)
        if n < 4 or c not in self._shaped:
            return None
        m2, m4 = self._moment(c, 2), self._moment(c, 4)
        if m2 < 1e-14:
            return 0.0
        bias = 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
        return n * (n + 1) * (n - 1) / ((n - 2) * (n - 3)) * m4 / m2 ** 2 - bias

    # ------------------------------------------------------------ quantiles

    def quantiles(
        self, columns: list[ColumnInfo], probabilities, **bounds
    ) -> dict[int, dict]:
        """Exact quantiles with linear interpolation: ``ordinal -> {p: value}``.

        ``bounds`` go to :func:`tablecheck.operators.ranks.order_statistics`.
        """
        out: dict[int, dict] = {}
        filled = [c for c in columns if self.count(c)]
        for start in range(0, len(filled), RANK_COLUMNS_PER_JOB):
            chunk = filled[start:start + RANK_COLUMNS_PER_JOB]
            counts = {c.ordinal: self.count(c) for c in chunk}
            places = {
                i: ranks.quantile_ranks(n, probabilities) for i, n in counts.items()
            }
            wanted = {
                i: {r for low, high, _ in p.values() for r in (low, high)}
                for i, p in places.items()
            }
            values = stacked(self.data, {c.ordinal: c.number() for c in chunk})
            found = ranks.order_statistics(values, counts, wanted, **bounds)
            for i, p in places.items():
                out[i] = {
                    q: ranks.interpolate(found[i][low], found[i][high], weight)
                    for q, (low, high, weight) in p.items()
                }
        return out

    @cached_property
    def _quartiles(self) -> dict[int, dict]:
        return self.quantiles(self.numeric, QUARTILES)

    def quartile(self, c: ColumnInfo, p: float) -> float | None:
        return self._quartiles.get(c.ordinal, {}).get(p)

    def outlier_bounds(self, c: ColumnInfo) -> tuple[float, float] | None:
        q1, q3 = self.quartile(c, 0.25), self.quartile(c, 0.75)
        if q1 is None:
            return None
        spread = q3 - q1
        return q1 - 1.5 * spread, q3 + 1.5 * spread

    def is_outlier(self, c: ColumnInfo) -> Column:
        """Predicate over :attr:`data`; the bounds are literals of two numbers."""
        low, high = self.outlier_bounds(c)
        return (c.number() < low) | (c.number() > high)

    @cached_property
    def _outliers(self) -> dict:
        wanted: dict = {}
        for c in self.numeric:
            bounds = self.outlier_bounds(c)
            if bounds is None or any(math.isnan(b) for b in bounds):
                continue
            flagged = F.when(self.is_outlier(c), c.number())
            wanted[(c.ordinal, "count")] = F.count(flagged)
            wanted[(c.ordinal, "min")] = F.min(flagged)
            wanted[(c.ordinal, "max")] = F.max(flagged)
        return collect_aggregates(self.data, wanted)

    def outlier(self, c: ColumnInfo, metric: str):
        return self._outliers.get((c.ordinal, metric))

    @cached_property
    def histograms(self) -> dict[int, tuple[np.ndarray, list[int]]]:
        edges = {}
        for c in self.numeric:
            if self.count(c):
                e = histograms.bin_edges(
                    self.count(c), self.value(c, "min"), self.value(c, "max")
                )
                if e is not None:
                    edges[c.ordinal] = e
        counts = histograms.histogram_counts(self.data, self.numeric, edges)
        return {i: (e, counts[i]) for i, e in edges.items()}

    # ------------------------------------------------------------ values

    @property
    def _counted_as_text(self) -> list[ColumnInfo]:
        return [
            c for c in self.columns
            if c.kind in (TEXT, OPAQUE)
            or (c.kind == NUMERIC and not frequencies.is_fixed_width(c))
        ]

    @cached_property
    def _frequencies(self) -> tuple[dict, dict]:
        totals = {c.ordinal: self.count(c) for c in self._counted_as_text}
        return frequencies.frequency_summary(self.data, self._counted_as_text, totals)

    @cached_property
    def _fixed_distinct(self) -> dict[int, int]:
        if self.approx_distinct:
            return frequencies.approximate_distinct_counts(
                self.data, [c for c in self.columns if c.kind != BOOLEAN]
            )
        fixed = [
            c for c in self.of_kind(NUMERIC, TIME) if frequencies.is_fixed_width(c)
        ]
        return frequencies.distinct_counts(self.data, fixed)

    def distinct(self, c: ColumnInfo) -> int:
        if c.kind == BOOLEAN:
            true = self.value(c, "true")
            return int(true > 0) + int(self.count(c) > true)
        if c.ordinal in self._fixed_distinct:
            return self._fixed_distinct[c.ordinal]
        return self._frequencies[0].get(c.ordinal, {}).get("distinct", 0)

    def rare_values(self, c: ColumnInfo) -> int | None:
        return self._frequencies[0].get(c.ordinal, {}).get("rare")

    def entropy(self, c: ColumnInfo) -> float | None:
        stats = self._frequencies[0].get(c.ordinal)
        if stats is None:
            return None
        n = self.count(c)
        return max(0.0, math.log2(n) - stats["n_log_n"] / n)

    def top(self, c: ColumnInfo) -> list[tuple[int, str, int]]:
        """Up to ten ``(rank, value, count)``, most frequent first, ties by value."""
        return self._frequencies[1].get(c.ordinal, [])

    def sample_values(
        self, columns: list[ColumnInfo], limit: int = 3, order_by: str | None = None
    ) -> dict[int, list[str]]:
        """Text of the first values by ``order_by``; by default the smallest distinct ones."""
        if order_by is not None:
            wanted = {c.ordinal: self._plain(c) for c in columns}
            return frequencies.first_values(self.data, wanted, limit, self._order(order_by))
        wanted = {c.ordinal: self._plain(c) for c in columns if c.kind != BOOLEAN}
        known = {
            c.ordinal: self.value(c, "smallest")
            for c in columns
            if c.kind in (NUMERIC, TEXT, TIME)
        }
        found = frequencies.smallest_values(self.data, wanted, limit, known)
        texts = {i: [self._text(v) for v in values] for i, values in found.items()}
        for c in columns:
            if c.kind == BOOLEAN:
                true = self.value(c, "true")
                seen = (("false", self.count(c) - true), ("true", true))
                texts[c.ordinal] = [t for t, n in seen if n]
        return texts

    def _plain(self, c: ColumnInfo) -> Column:
        return frequencies.text_value(c) if c.kind == OPAQUE else F.col(c.key)

    @staticmethod
    def _text(value) -> str:
        return value if isinstance(value, str) else str(value)

    def first_outliers(self, limit: int = 5, order_by: str | None = None) -> dict[int, list]:
        """First outliers per column by ``order_by``; by default the smallest distinct ones."""
        wanted = {
            c.ordinal: F.when(self.is_outlier(c), c.number())
            for c in self.numeric
            if self.outlier(c, "count")
        }
        if order_by is None:
            known = {c.ordinal: self.outlier(c, "min") for c in self.numeric if c.ordinal in wanted}
            return frequencies.smallest_values(self.data, wanted, limit, known)
        found = frequencies.first_values(self.data, wanted, limit, self._order(order_by))
        return {i: [float(v) for v in values] for i, values in found.items()}

    def _order(self, name: str) -> Column:
        return F.col(self.column(name).key)

    # ------------------------------------------------------------ pairs and rows

    @cached_property
    def _pair_sums(self) -> dict:
        shaped = self._shaped
        centred = self.data.select(
            *[self._centred(c).alias(f"v{c.ordinal}") for c in shaped]
        )
        return relations.pair_sums(
            centred, [c.ordinal for c in shaped], self._wide_sum_columns
        )

    def correlation(self, a: ColumnInfo, b: ColumnInfo) -> float | None:
        """Pearson over rows where both are present; None when undefined."""
        if a == b:
            flat = a not in self._shaped or self.is_flat(a) or self.count(a) < 2
            return None if flat else 1.0
        low, high = sorted((a.ordinal, b.ordinal))
        sums = self._pair_sums.get((low, high))
        return None if sums is None else relations.pearson(sums)

    @cached_property
    def co_missing(self) -> dict[tuple[int, int], int]:
        gaps = {
            c.ordinal: F.col(c.key).isNull() for c in self.columns if self.missing(c)
        }
        return relations.co_missing_counts(self.data, gaps)

    @cached_property
    def duplicate_rows(self) -> int:
        if not self.columns:
            return 0
        return duplicates.duplicate_rows(self.data, verify=self.verify_duplicates)

    @property
    def duplicate_pct(self) -> float:
        return self.duplicate_rows / self.row_count * 100 if self.row_count else 0.0
