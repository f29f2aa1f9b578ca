"""Selections, profile, statistics, distributions, outliers and missing values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.registry import query
from checks.statements import DIRTY, LINE, WEB, each, pairs, pct, r
from checks.views import portable, table, view
from tablecheck.functions.numeric import percent
from tablecheck.operators.duplicates import duplicate_rows
from tablecheck.operators import frequencies
from tablecheck.operators.frequencies import value_counts
from tablecheck.operators.freshness import time_columns
from tablecheck.operators.metrics import TableMetrics
from tablecheck.operators.table import describe_columns
from tablecheck.plans import eda, profile, schema
from tablecheck.session import small_frame


def metrics_of(spark, sf, name, **options) -> TableMetrics:
    return TableMetrics(view(spark, sf, name), **options)


def frame(metrics, rows, ddl):
    metrics.release()
    return small_frame(metrics.spark, rows, ddl)


def r4(*names):
    return [(F.rint(F.col(n) * 1e4) / 1e4).alias(n) for n in names]


# ------------------------------------------------------------------ selections


@query(
    "c01_columns_by_type",
    """SELECT column_name AS "column", CASE
         WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
         WHEN column_type = 'VARCHAR' THEN 'text'
         WHEN column_type = 'TIMESTAMP' THEN 'time' ELSE 'opaque' END AS kind
       FROM (DESCRIBE lineitem)
       UNION ALL SELECT column_name, CASE WHEN column_name = 'embedding' THEN 'opaque' ELSE 'numeric' END
       FROM (DESCRIBE embeddings)""",
)
def columns_by_type(spark, sf):
    found = [
        {"column": c.name, "kind": c.kind}
        for name in ("lineitem", "embeddings")
        for c in describe_columns(table(spark, sf, name))
    ]
    return small_frame(spark, found, "column string, kind string")


@query(
    "c02_columns_by_name",
    """SELECT column_name AS "column" FROM (DESCRIBE orders) WHERE column_name LIKE '%date%'
       UNION ALL SELECT column_name FROM (DESCRIBE lineitem) WHERE column_name LIKE '%date%'
       UNION ALL SELECT 'timestamp'""",
)
def columns_by_name(spark, sf):
    names = [
        {"column": n}
        for source in ("orders", "lineitem", "web_log")
        for n in time_columns(view(spark, sf, source))
    ]
    return small_frame(spark, names, "column string")


@query(
    "c03_present_values",
    portable(each(DIRTY, "SELECT {name} AS \"column\", count({c}) AS present FROM dirty_orders")),
)
def present_values(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    rows = [{"column": c.name, "present": m.count(c)} for c in m.columns]
    return frame(m, rows, "column string, present bigint")


BOUNDS = """(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {v}) AS b"""
PRICE_BOUNDS = BOUNDS.replace("{c}", "o_totalprice").replace("{v}", "dirty_orders")
IS_OUT = "({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
PRICE_OUT = IS_OUT.replace("{c}", "o_totalprice")


@query(
    "c04_outlier_rows",
    portable(f"SELECT o_orderkey, o_totalprice FROM dirty_orders, {PRICE_BOUNDS} WHERE {PRICE_OUT}"),
)
def outlier_rows(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    return eda.outlier_rows(m, "o_totalprice").select("o_orderkey", "o_totalprice")


@query(
    "d03_bounds_back_to_rows",
    portable(
        f"SELECT o_orderkey, o_totalprice, {PRICE_OUT} AS is_outlier FROM dirty_orders, {PRICE_BOUNDS}"
    ),
)
def bounds_back_to_rows(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    key, price = m.column("o_orderkey"), m.column("o_totalprice")
    return m.data.select(
        F.col(key.key).alias("o_orderkey"), F.col(price.key).alias("o_totalprice"),
        m.is_outlier(price).alias("is_outlier"),
    )


@query(
    "d02_column_pairs",
    portable(pairs(LINE, "SELECT {an} AS col1, {bn} AS col2")),
)
def column_pairs(spark, sf):
    columns = [c for c in describe_columns(table(spark, sf, "lineitem")) if c.kind == "numeric"]
    rows = [
        {"col1": a.name, "col2": b.name} for i, a in enumerate(columns) for b in columns[i + 1:]
    ]
    return small_frame(spark, rows, "col1 string, col2 string")


# ------------------------------------------------------------------ profile


@query(
    "e01_row_count",
    portable(
        "SELECT 'dirty_orders' AS source, count(*) AS row_count FROM dirty_orders "
        "UNION ALL SELECT 'lineitem', count(*) FROM lineitem "
        "UNION ALL SELECT 'documents', count(*) FROM documents"
    ),
)
def row_count(spark, sf):
    rows = []
    for name in ("dirty_orders", "lineitem", "documents"):
        m = metrics_of(spark, sf, name)
        rows.append({"source": name, "row_count": m.row_count})
        m.release()
    return small_frame(spark, rows, "source string, row_count bigint")


def repeats(view_name, columns):
    names = ", ".join(f'"{c}"' for c in columns)
    return (
        f"SELECT '{view_name}' AS source, count(*) - (SELECT count(*) FROM "
        f"(SELECT DISTINCT {names} FROM {view_name})) AS duplicate_rows FROM {view_name}"
    )


@query(
    "e02_duplicate_rows",
    portable(
        repeats("dirty_orders", [c.name for c in DIRTY])
        + " UNION ALL " + repeats("very_dirty_orders", [c.name for c in DIRTY])
        + " UNION ALL " + repeats("lineitem", [c.name for c in LINE])
        + " UNION ALL SELECT 'documents', count(*) - count(DISTINCT text) FROM documents"
    ),
)
def duplicates_direct(spark, sf):
    rows = []
    for name in ("dirty_orders", "very_dirty_orders", "lineitem"):
        m = metrics_of(spark, sf, name)
        rows.append({"source": name, "duplicate_rows": m.duplicate_rows})
        m.release()
    texts = table(spark, sf, "documents").select("text")
    rows.append({"source": "documents", "duplicate_rows": duplicate_rows(texts)})
    return small_frame(spark, rows, "source string, duplicate_rows bigint")


@query(
    "e02_duplicate_rows_by_fingerprint",
    portable(
        repeats("dirty_orders", [c.name for c in DIRTY])
        + " UNION ALL " + repeats("very_dirty_orders", [c.name for c in DIRTY])
        + " UNION ALL " + repeats("lineitem", [c.name for c in LINE])
    ),
)
def duplicates_by_fingerprint(spark, sf):
    """Filters of many bits, of so few that nearly all rows pass, and no repeats at all."""
    rows = []
    for name, bits in (("dirty_orders", 1 << 20), ("very_dirty_orders", 64), ("lineitem", 64)):
        rows.append({"source": name, "duplicate_rows": duplicate_rows(view(spark, sf, name), filter_bits=bits)})
    return small_frame(spark, rows, "source string, duplicate_rows bigint")


@query(
    "e03_missing",
    portable(
        each(
            DIRTY,
            "SELECT {name} AS \"column\", count(*) - count({c}) AS missing_count, "
            + pct("(count(*) - count({c}))", "count(*)") + " AS missing_pct FROM dirty_orders",
        )
    ),
)
def missing(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    rows = [
        {"column": c.name, "missing_count": m.missing(c), "missing_pct": m.missing_pct(c)}
        for c in m.columns
    ]
    return frame(m, rows, "column string, missing_count bigint, missing_pct double")


UNIQUE = "SELECT {name} AS \"column\", count(DISTINCT {c}) AS unique_count FROM "


def unique_rows(m):
    return [{"column": c.name, "unique_count": m.distinct(c)} for c in m.columns]


@query(
    "e04_unique_count",
    portable(each(DIRTY, UNIQUE + "dirty_orders") + " UNION ALL " + each(LINE, UNIQUE + "lineitem")),
)
def unique_count(spark, sf):
    rows = []
    for name in ("dirty_orders", "lineitem"):
        m = metrics_of(spark, sf, name)
        rows += unique_rows(m)
        m.release()
    return small_frame(spark, rows, "column string, unique_count bigint")


@query(
    "e04_unique_count_nested",
    "SELECT 'vec_id' AS \"column\", count(DISTINCT vec_id) AS unique_count FROM embeddings "
    "UNION ALL SELECT 'embedding', count(DISTINCT embedding) FROM embeddings "
    "UNION ALL SELECT 'label', count(DISTINCT label) FROM embeddings",
)
def unique_count_nested(spark, sf):
    m = metrics_of(spark, sf, "embeddings")
    return frame(m, unique_rows(m), "column string, unique_count bigint")


@query(
    "e04_approximate_unique_count",
    each(LINE, "SELECT {name} AS \"column\", true AS within_5_pct"),
)
def approximate_unique_count(spark, sf):
    exact, close = metrics_of(spark, sf, "lineitem"), metrics_of(spark, sf, "lineitem", approx_distinct=True)
    rows = [
        {"column": c.name, "within_5_pct": abs(close.distinct(c) - exact.distinct(c)) <= 0.05 * exact.distinct(c) + 1}
        for c in exact.columns
    ]
    close.release()
    return frame(exact, rows, "column string, within_5_pct boolean")


@query(
    "e05_is_constant",
    portable(each(DIRTY, "SELECT {name} AS \"column\", count(DISTINCT {c}) <= 1 AS is_constant FROM dirty_orders")),
)
def is_constant(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    rows = [{"column": c.name, "is_constant": m.distinct(c) <= 1} for c in m.columns]
    return frame(m, rows, "column string, is_constant boolean")


def column_profile(spark, sf, name):
    m = metrics_of(spark, sf, name)
    found = profile.column_profile(m)
    m.release()
    return found


@query(
    "e06_boolean_profile",
    portable(
        "SELECT count(*) FILTER (is_even) AS true_count, count(*) FILTER (NOT is_even) AS false_count, "
        + pct("count(*) FILTER (is_even)", "count(is_even)") + " AS true_pct FROM dirty_orders"
    ),
)
def boolean_profile(spark, sf):
    found = column_profile(spark, sf, "dirty_orders").where("kind = 'boolean'")
    return found.select("true_count", "false_count", "true_pct")


NUMERIC_PROFILE = (
    'SELECT {name} AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, '
    + r("avg({c})", 4) + " AS mean, " + r("median({c})", 4) + " AS median, "
    + r("stddev_samp({c})", 4) + " AS std, count(*) FILTER ({c} = 0) AS zero_count FROM "
)


@query(
    "e07_numeric_profile",
    portable(
        each(DIRTY, NUMERIC_PROFILE + "dirty_orders", ("numeric",)) + " UNION ALL "
        + each(LINE, NUMERIC_PROFILE + "lineitem", ("numeric",))
    ),
)
def numeric_profile(spark, sf):
    both = column_profile(spark, sf, "dirty_orders").unionByName(column_profile(spark, sf, "lineitem"))
    return both.where("kind = 'numeric'").select(
        "column", "min", "max", *r4("mean", "median", "std"), "zero_count"
    )


OUT_COUNT = (
    'SELECT {name} AS "column", count(*) FILTER ' + f"(WHERE {IS_OUT})" + " AS outlier_count FROM {v}, " + BOUNDS
)


@query(
    "e08_outlier_count",
    portable(
        each(DIRTY, OUT_COUNT.replace("{v}", "dirty_orders"), ("numeric",)) + " UNION ALL "
        + each(WEB, OUT_COUNT.replace("{v}", "web_log"), ("numeric",))
    ),
)
def outlier_count(spark, sf):
    both = column_profile(spark, sf, "dirty_orders").unionByName(column_profile(spark, sf, "web_log"))
    return both.where("kind = 'numeric'").select("column", "outlier_count")


CATEGORICAL = """
    SELECT {name} AS "column", arg_max(value, (n, place)) AS most_frequent, """ + pct(
    "max(n)", "sum(n)"
) + """ AS most_frequent_pct,
      count(*) FILTER (n / total < 0.05) AS rare_value_count
    FROM (SELECT *, -row_number() OVER (ORDER BY value) AS place, sum(n) OVER () AS total FROM (
      SELECT {c} AS value, CAST(count(*) AS DOUBLE) AS n FROM {v} WHERE {c} IS NOT NULL GROUP BY {c}))
"""


@query(
    "e09_categorical_profile",
    portable(
        each(DIRTY, CATEGORICAL.replace("{v}", "dirty_orders"), ("text",)) + " UNION ALL "
        + each(WEB, CATEGORICAL.replace("{v}", "web_log"), ("text",))
    ),
)
def categorical_profile(spark, sf):
    both = column_profile(spark, sf, "dirty_orders").unionByName(column_profile(spark, sf, "web_log"))
    return both.where("kind = 'text'").select(
        "column", "most_frequent", "most_frequent_pct", "rare_value_count"
    )


ENRICHED = (
    'SELECT {name} AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, '
    + r("avg(CAST({c} AS DOUBLE))", 4) + " AS mean, "
    + r("stddev_samp(CAST({c} AS DOUBLE))", 4) + " AS std FROM dirty_orders"
)


@query("e10_schema_enrichment", portable(each(DIRTY, ENRICHED, ("numeric", "boolean"))))
def schema_enrichment(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    found = schema.column_schema(m).where("max is not null")
    m.release()
    return found.select("column", "min", "max", *r4("mean", "std"))


SEMANTIC = 'SELECT {name} AS "column", {semantic} AS semantic_type'


@query("e10_semantic_types", each(DIRTY, SEMANTIC) + " UNION ALL " + each(WEB, SEMANTIC))
def semantic_types(spark, sf):
    rows = [
        {"column": c.name, "semantic_type": schema.semantic_type(c)}
        for name in ("dirty_orders", "web_log")
        for c in describe_columns(view(spark, sf, name))
    ]
    return small_frame(spark, rows, "column string, semantic_type string")


# ------------------------------------------------------------------ logs and validators


@query(
    "e11_status_distribution",
    portable(
        "SELECT CAST(status AS VARCHAR) AS status, count(*) AS count, "
        + pct("count(*)", "(SELECT count(status) FROM web_log)") + " AS pct FROM web_log GROUP BY status"
    ),
)
def status_distribution(spark, sf):
    return profile.status_distribution(metrics_of(spark, sf, "web_log"))


@query(
    "e12_error_rate",
    portable(
        "SELECT " + pct("count(*) FILTER (status IN (500, 502, 503))", "count(status)")
        + " AS error_rate_pct FROM web_log"
    ),
)
def error_rate(spark, sf):
    m = metrics_of(spark, sf, "web_log")
    return frame(m, [{"error_rate_pct": profile.error_rate(m)}], "error_rate_pct double")


@query("e13_time_span", 'SELECT min(ts) AS "start", max(ts) AS "end" FROM events')
def time_span(spark, sf):
    span = profile.time_span(metrics_of(spark, sf, "web_log"))
    return span.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in span.columns])


@query(
    "e14_invalid_ip",
    portable(
        "SELECT " + pct(
            "count(*) FILTER (NOT regexp_matches(ip, '^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^([a-fA-F0-9:]+)$'))",
            "count(ip)",
        ) + " AS invalid_ip_pct FROM web_log"
    ),
)
def invalid_ip(spark, sf):
    m = metrics_of(spark, sf, "web_log")
    rows = [{"invalid_ip_pct": schema.invalid_ip_pct(m, m.column("ip"))}]
    return frame(m, rows, "invalid_ip_pct double")


@query(
    "e15_unparseable_timestamp",
    "SELECT " + pct("count(*) FILTER (event_id % 5 = 1)", "count(*)")
    + " AS text_pct, " + pct("count(*) FILTER (event_id % 37 = 0)", "count(*)")
    + " AS log_pct, 0.0::DOUBLE AS typed_pct FROM events",
)
def unparseable_timestamp(spark, sf):
    from tablecheck.sources.logs import parse_log

    row = {}
    parsed = parse_log(view(spark, sf, "log_lines"), "apache_combined")
    for name, data in (
        ("text_pct", view(spark, sf, "status_texts")),
        ("log_pct", parsed),
        ("typed_pct", view(spark, sf, "web_log")),
    ):
        m = TableMetrics(data)
        row[name] = schema.unparseable_timestamp_pct(m, m.column("timestamp"))
        m.release()
    return small_frame(spark, [row], "text_pct double, log_pct double, typed_pct double")


@query(
    "e16_invalid_status",
    "SELECT " + pct("count(*) FILTER (event_id % 6 IN (1, 2, 3, 4))", "count(*)")
    + " AS text_pct, " + pct("count(*) FILTER (event_id % 200 = 0)", "count(*)")
    + " AS number_pct FROM events",
)
def invalid_status(spark, sf):
    row = {}
    for name, source in (("text_pct", "status_texts"), ("number_pct", "web_log")):
        m = metrics_of(spark, sf, source)
        row[name] = schema.invalid_status_pct(m, m.column("status"))
        m.release()
    return small_frame(spark, [row], "text_pct double, number_pct double")


# ------------------------------------------------------------------ numeric statistics

NUMERIC_SUMMARY = ('SELECT {name} AS "column", count({c}) AS count, ' + ", ".join(
    f"{r(e, 4)} AS {n}" for n, e in (
        ("mean", "avg({c})"), ("median", "median({c})"), ("std", "stddev_samp({c})"),
        ("min", "min({c})"), ("max", "max({c})"), ("q1", "quantile_cont({c}, 0.25)"),
        ("q3", "quantile_cont({c}, 0.75)"),
        ("iqr", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
        ("cv", "stddev_samp({c}) / nullif(avg({c}), 0)"),
    )
) + " FROM ")


@query(
    "e17_numeric_summary",
    portable(
        each(DIRTY, NUMERIC_SUMMARY + "dirty_orders", ("numeric",)) + " UNION ALL "
        + each(LINE, NUMERIC_SUMMARY + "lineitem", ("numeric",))
    ),
)
def numeric_summary(spark, sf):
    found = []
    for name in ("dirty_orders", "lineitem"):
        m = metrics_of(spark, sf, name)
        found.append(eda.numeric_summary(m).drop("ordinal", "skewness", "kurtosis"))
        m.release()
    return found[0].unionByName(found[1])


SHAPE = (
    'SELECT {name} AS "column", ' + r("skewness({c})", 4) + " AS skewness, "
    + r("kurtosis({c})", 4) + " AS kurtosis FROM "
)


@query(
    "e18_skewness_kurtosis",
    portable(
        each(DIRTY, SHAPE + "dirty_orders", ("numeric",)) + " UNION ALL "
        + each(LINE, SHAPE + "lineitem", ("numeric",))
    ),
)
def skewness_kurtosis(spark, sf):
    rows = []
    for name in ("dirty_orders", "lineitem"):
        m = metrics_of(spark, sf, name)
        rows += [
            {"column": c.name, "skewness": m.skewness(c), "kurtosis": m.kurtosis(c)}
            for c in m.numeric
        ]
        m.release()
    found = small_frame(spark, rows, "column string, skewness double, kurtosis double")
    return found.select("column", *r4("skewness", "kurtosis"))


QUANTILES = 'SELECT {name} AS "column", ' + ", ".join(
    f"quantile_cont(CAST({{c}} AS DOUBLE), {p}) AS {n}"
    for n, p in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99))
) + " FROM lineitem"


def round_all(names):
    return ", ".join(f"{r(n, 6)} AS {n}" for n in names)


QS = ("p01", "p25", "p50", "p75", "p99")


@query(
    "e19_quantiles",
    f"SELECT \"column\", {round_all(QS)} FROM ({each(LINE, QUANTILES, ('numeric',))})",
)
def quantiles(spark, sf):
    return quantile_frame(spark, sf)


def quantile_frame(spark, sf, **bounds):
    m = metrics_of(spark, sf, "lineitem")
    probabilities = (0.01, 0.25, 0.5, 0.75, 0.99)
    found = m.quantiles(m.numeric, probabilities, **bounds)
    rows = [
        {"column": c.name, **{n: found[c.ordinal][p] for n, p in zip(QS, probabilities)}}
        for c in m.numeric
    ]
    flat = frame(m, rows, "column string, " + ", ".join(f"{n} double" for n in QS))
    return flat.select("column", *[(F.rint(F.col(n) * 1e6) / 1e6).alias(n) for n in QS])


@query(
    "e19_quantiles_by_refinement",
    f"SELECT \"column\", {round_all(QS)} FROM ({each(LINE, QUANTILES, ('numeric',))})",
)
def quantiles_by_refinement(spark, sf):
    """The way of large tables, forced by tiny bounds: several rounds of narrowing."""
    return quantile_frame(spark, sf, fetch_budget=2_000, sample_rows=1_000)


# ------------------------------------------------------------------ correlation


def pearson_sql(source, digits=4):
    return (
        "SELECT {an} AS col1, {bn} AS col2, "
        + r("CASE WHEN isnan(c) THEN NULL ELSE c END", digits)
        + f" AS correlation FROM (SELECT corr({{a}}, {{b}}) AS c FROM {source})"
    )


def both_ways(source, columns):
    one = pairs(columns, pearson_sql(source))
    diagonal = each(
        columns,
        "SELECT {name} AS col1, {name} AS col2, "
        f"CASE WHEN min({{c}}) < max({{c}}) THEN 1.0::DOUBLE END AS correlation FROM {source}",
        ("numeric",),
    )
    return (
        f"SELECT * FROM ({one}) UNION ALL SELECT col2, col1, correlation FROM ({one}) "
        f"UNION ALL {diagonal}"
    )


@query(
    "e20_pearson",
    portable(both_ways("dirty_orders", DIRTY) + " UNION ALL " + both_ways("lineitem", LINE)),
)
def pearson(spark, sf):
    found = []
    for name in ("dirty_orders", "lineitem"):
        m = metrics_of(spark, sf, name)
        found.append(eda.correlation_matrix(m))
        m.release()
    return found[0].unionByName(found[1])


@query(
    "e20_pearson_by_blocks",
    portable(pairs(DIRTY, pearson_sql("dirty_orders")) + " UNION ALL " + pairs(LINE, pearson_sql("lineitem"))),
)
def pearson_by_blocks(spark, sf):
    """The way of wide tables: Gram blocks per task."""
    rows = []
    for name in ("dirty_orders", "lineitem"):
        m = metrics_of(spark, sf, name, wide_sum_columns=1)
        rows += [
            {"col1": a.name, "col2": b.name, "correlation": m.correlation(a, b)}
            for i, a in enumerate(m.numeric) for b in m.numeric[i + 1:]
        ]
        m.release()
    flat = small_frame(spark, rows, "col1 string, col2 string, correlation double")
    return flat.select("col1", "col2", *r4("correlation"))


LINKED = """
    SELECT l_quantity AS quantity, l_quantity * 2 + l_linenumber AS double_quantity,
      -l_extendedprice AS cost, l_extendedprice * (1 - l_discount) AS revenue, l_tax AS tax
    FROM lineitem
"""


def linked(spark, sf):
    text = LINKED.replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(text, lineitem=table(spark, sf, "lineitem"))


LINKED_NAMES = ("quantity", "double_quantity", "cost", "revenue", "tax")


def linked_pairs(select, limit):
    parts = [
        f"SELECT {i * 10 + j} AS o, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM linked"
        for i, a in enumerate(LINKED_NAMES)
        for j, b in enumerate(LINKED_NAMES) if i < j
    ]
    return f"WITH linked AS ({LINKED}), p AS ({' UNION ALL '.join(parts)}) {select} FROM p WHERE abs(c) > {limit}"


@query(
    "e21_strong_pairs",
    linked_pairs(
        f"SELECT a AS col1, b AS col2, {r('c', 4)} AS correlation, "
        "CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END AS type, "
        "CASE WHEN abs(c) > 0.9 THEN 'very strong' ELSE 'strong' END AS strength",
        0.7,
    ),
)
def strong_pairs(spark, sf):
    m = TableMetrics(linked(spark, sf))
    found = eda.strong_correlations(m)
    m.release()
    return found


# ------------------------------------------------------------------ distributions

HISTOGRAM = """
    SELECT {name} AS "column", CAST(b.bin AS INTEGER) AS bin, """ + r("b.low", 4) + """ AS bin_start,
      count(v.x) AS count
    FROM (SELECT i AS bin, lo + i * ((hi - lo) / k) AS low,
            CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / k) END AS high, i = k - 1 AS last
          FROM (SELECT CAST(min({c}) AS DOUBLE) - CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS lo,
                  CAST(max({c}) AS DOUBLE) + CASE WHEN min({c}) = max({c}) THEN 0.5 ELSE 0 END AS hi,
                  least(20, count({c}) // 5) AS k FROM {v}), range(20) AS g(i) WHERE i < k) AS b
    LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS x FROM {v} WHERE {c} IS NOT NULL) AS v
      ON v.x >= b.low AND (v.x < b.high OR (b.last AND v.x <= b.high))
    GROUP BY b.bin, b.low
"""


@query(
    "e22_histogram",
    portable(
        each(DIRTY, HISTOGRAM.replace("{v}", "dirty_orders"), ("numeric",)) + " UNION ALL "
        + each(LINE, HISTOGRAM.replace("{v}", "lineitem"), ("numeric",))
    ),
)
def histogram(spark, sf):
    found = []
    for name in ("dirty_orders", "lineitem"):
        m = metrics_of(spark, sf, name)
        found.append(eda.histograms(m).drop("ordinal"))
        m.release()
    return found[0].unionByName(found[1])


SHAPES = """
    SELECT {name} AS "column", CASE WHEN abs(g) < 0.5 THEN 'normal' WHEN g > 1 THEN 'right_skewed'
      WHEN g < -1 THEN 'left_skewed' ELSE 'slightly_skewed' END AS shape
    FROM (SELECT skewness({c}) AS g FROM {v})
"""


@query(
    "e23_distribution_shape",
    portable(
        each(DIRTY, SHAPES.replace("{v}", "dirty_orders"), ("numeric",)) + " UNION ALL "
        + each(WEB, SHAPES.replace("{v}", "web_log"), ("numeric",))
    ),
)
def distribution_shape(spark, sf):
    found = []
    for name in ("dirty_orders", "web_log"):
        m = metrics_of(spark, sf, name)
        found.append(eda.distribution_shapes(m).drop("ordinal"))
        m.release()
    return found[0].unionByName(found[1])


# ------------------------------------------------------------------ text columns


def summaries(spark, sf, *columns):
    found = []
    for name in ("dirty_orders", "web_log"):
        m = metrics_of(spark, sf, name)
        found.append(eda.categorical_summary(m).select(*columns))
        m.release()
    return found[0].unionByName(found[1])


SUMMARY = 'SELECT {name} AS "column", count(DISTINCT {c}) AS unique_count, count({c}) AS total FROM '


@query(
    "e24_categorical_summary",
    portable(
        each(DIRTY, SUMMARY + "dirty_orders", ("text",)) + " UNION ALL "
        + each(WEB, SUMMARY + "web_log", ("text",))
    ),
)
def categorical_summary(spark, sf):
    return summaries(spark, sf, "column", "unique_count", "total")


ENTROPY = 'SELECT {name} AS "column", ' + r("entropy({c})", 4) + " AS entropy FROM {v} WHERE {c} IS NOT NULL"


@query(
    "e25_entropy",
    portable(
        each(DIRTY, ENTROPY.replace("{v}", "dirty_orders"), ("text",)) + " UNION ALL "
        + each(WEB, ENTROPY.replace("{v}", "web_log"), ("text",))
    ),
)
def entropy(spark, sf):
    return summaries(spark, sf, "column", "entropy")


RANKED = """
    SELECT {name} AS "column", CAST(rank AS INTEGER) AS rank, value, n AS count, """ + pct("n", "total") + """ AS pct
    FROM (SELECT {c} AS value, count(*) AS n, sum(count(*)) OVER () AS total,
            row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
          FROM {v} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}
"""


def ranked(columns, source, k):
    return each(columns, RANKED.replace("{v}", source).replace("{k}", str(k)), ("text",))


@query("f01_mode", portable("SELECT \"column\", value AS mode FROM (" + ranked(DIRTY, "dirty_orders", 1) + ")"))
def mode(spark, sf):
    found = column_profile(spark, sf, "dirty_orders").where("kind = 'text'")
    return found.select("column", F.col("most_frequent").alias("mode"))


@query(
    "f02_top_values",
    portable(ranked(DIRTY, "dirty_orders", 10) + " UNION ALL " + ranked(WEB, "web_log", 10)),
)
def top_ten(spark, sf):
    found = []
    for name in ("dirty_orders", "web_log"):
        m = metrics_of(spark, sf, name)
        found.append(eda.top_values(m).drop("ordinal"))
        m.release()
    return found[0].unionByName(found[1])


@query(
    "f02_top_texts",
    """SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM (
         SELECT text AS value, count(*) AS n FROM documents GROUP BY text ORDER BY n DESC, text LIMIT 10)""",
)
def top_texts(spark, sf):
    """Long free texts, most of them found once: leaders are told by digests, texts fetched late."""
    m = TableMetrics(table(spark, sf, "documents"))
    found = frequencies.top_values(m.data, [m.column("text")], 10)[m.column("text").ordinal]
    rows = [{"rank": k, "value": value, "n": n} for k, value, n in found]
    m.release()
    return small_frame(spark, rows, "rank int, value string, n bigint")


@query(
    "e04_unique_texts",
    """WITH n AS (SELECT text, count(*) AS n FROM documents GROUP BY text),
       t AS (SELECT count(*) AS total FROM documents)
       SELECT count(*) AS distinct_texts, round_even(sum(-(n / total) * log2(n / total)) * 1e6, 0) / 1e6 AS entropy
       FROM n, t""",
)
def unique_texts(spark, sf):
    m = TableMetrics(table(spark, sf, "documents"))
    c = m.column("text")
    total, found = m.count(c), m._frequencies[0][c.ordinal]
    entropy = math.log2(total) - found["n_log_n"] / total
    m.release()
    row = {"distinct_texts": found["distinct"], "entropy": round(entropy * 1e6) / 1e6}
    return small_frame(spark, [row], "distinct_texts bigint, entropy double")


SHARES = """
    SELECT {name} AS "column", {c} AS value, count(*) AS count,
      """ + pct("count(*)", "(SELECT count({c}) FROM web_log)") + """ AS pct
    FROM web_log WHERE {c} IS NOT NULL GROUP BY {c}
"""


@query("f03_share_of_total", portable(each(WEB, SHARES, ("text",))))
def share_of_total(spark, sf):
    m = metrics_of(spark, sf, "web_log")
    text = m.of_kind("text")
    counts = value_counts(m.data, text)
    facts_ = small_frame(
        spark, [{"i": c.ordinal, "column": c.name, "total": m.count(c)} for c in text],
        "i int, column string, total bigint",
    )
    joined = counts.join(F.broadcast(facts_), "i")
    return joined.select(
        "column", "value", F.col("n").alias("count"), percent(F.col("n"), F.col("total")).alias("pct")
    )


@query(
    "f04_worst_column",
    portable(
        "SELECT \"column\" FROM ("
        + each(DIRTY, 'SELECT {i} AS i, {name} AS "column", count(*) - count({c}) AS gaps FROM dirty_orders')
        + ") ORDER BY gaps DESC, i LIMIT 1"
    ),
)
def worst_column(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    return frame(m, [{"column": eda.worst_missing(m).name}], "column string")


@query("g01_top_ips", portable("SELECT rank, value, count FROM (" + ranked(WEB[1:2], "web_log", 5) + ")"))
def top_ips(spark, sf):
    return profile.top_log_values(metrics_of(spark, sf, "web_log"), "ip")


@query("g02_top_endpoints", portable("SELECT rank, value, count FROM (" + ranked(WEB[4:5], "web_log", 5) + ")"))
def top_endpoints(spark, sf):
    return profile.top_log_values(metrics_of(spark, sf, "web_log"), "endpoint")


@query(
    "g03_sample_values",
    """SELECT 'o_custkey' AS "column", list(CAST(o_custkey AS VARCHAR) ORDER BY o_orderkey) AS sample_values
       FROM (SELECT * FROM orders WHERE o_orderkey % 10 >= 3 ORDER BY o_orderkey LIMIT 3)
       UNION ALL SELECT 'o_orderpriority', list(o_orderpriority ORDER BY o_orderkey)
       FROM (SELECT * FROM orders WHERE o_orderkey % 10 >= 6 ORDER BY o_orderkey LIMIT 3)""",
)
def sample_values(spark, sf):
    m = TableMetrics(view(spark, sf, "dirty_base"))
    found = schema.column_schema(m, order_by="o_orderkey").select("column", "sample_values")
    m.release()
    return found.where(F.col("column").isin("o_custkey", "o_orderpriority"))


SMALLEST = """
    SELECT {name} AS "column", list(CAST(v AS {t}) ORDER BY v) AS sample_values FROM
    (SELECT DISTINCT {c} AS v FROM lineitem WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 3)
"""


@query(
    "g03_smallest_values",
    each(LINE[:4], SMALLEST.replace("{t}", "VARCHAR")) + " UNION ALL "
    + each(LINE[8:10], SMALLEST.replace("{t}", "VARCHAR")),
)
def smallest_values(spark, sf):
    m = metrics_of(spark, sf, "lineitem")
    found = schema.column_schema(m).select("ordinal", "column", "sample_values")
    m.release()
    return found.where("ordinal < 4 or ordinal in (8, 9)").drop("ordinal")


@query(
    "g04_first_outliers",
    portable(
        f"SELECT o_orderkey, o_totalprice FROM dirty_base, {PRICE_BOUNDS.replace('dirty_orders', 'dirty_base')} "
        f"WHERE {PRICE_OUT} ORDER BY o_orderkey LIMIT 5"
    ),
)
def first_outliers(spark, sf):
    m = TableMetrics(view(spark, sf, "dirty_base"))
    outliers = eda.outlier_rows(m, "o_totalprice")
    return outliers.orderBy("o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


OUTLIERS = """
    SELECT {name} AS "column", count(*) AS count, """ + pct("count(*)", "(SELECT count({c}) FROM {v})") + """ AS pct,
      """ + r("q1 - 1.5 * (q3 - q1)", 4) + " AS lower_bound, " + r("q3 + 1.5 * (q3 - q1)", 4) + """ AS upper_bound,
      """ + r("min({c})", 4) + " AS min_outlier, " + r("max({c})", 4) + """ AS max_outlier
    FROM {v}, """ + BOUNDS + " WHERE " + IS_OUT + " GROUP BY q1, q3 "


@query(
    "e26_outlier_report",
    portable(
        each(DIRTY, OUTLIERS.replace("{v}", "dirty_orders"), ("numeric",)) + " UNION ALL "
        + each(WEB, OUTLIERS.replace("{v}", "web_log"), ("numeric",))
    ),
)
def outlier_report(spark, sf):
    found = []
    for name in ("dirty_orders", "web_log"):
        m = metrics_of(spark, sf, name)
        found.append(eda.outlier_analysis(m).drop("ordinal", "sample_outliers"))
        m.release()
    return found[0].unionByName(found[1])


@query(
    "g04_sample_outliers",
    portable(
        f"""SELECT 'o_totalprice' AS "column", list(x ORDER BY x) AS sample_outliers FROM
            (SELECT DISTINCT {r('o_totalprice', 4)} AS x FROM dirty_orders, {PRICE_BOUNDS}
             WHERE {PRICE_OUT} ORDER BY x LIMIT 5)"""
    ),
)
def sample_outliers(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    found = eda.outlier_analysis(m).select("column", "sample_outliers")
    m.release()
    return found


# ------------------------------------------------------------------ missing values

GAPS = (
    'SELECT {i} AS i, {name} AS "column", count(*) - count({c}) AS missing_count, '
    + pct("(count(*) - count({c}))", "count(*)") + " AS missing_pct FROM dirty_orders"
)


@query(
    "e27_missing_columns",
    portable(f"SELECT \"column\", missing_count, missing_pct FROM ({each(DIRTY, GAPS)}) WHERE missing_count > 0"),
)
def missing_columns(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    found = eda.missing_columns(m).drop("ordinal")
    m.release()
    return found


@query(
    "g05_missing_by_rank",
    portable(
        "SELECT CAST(row_number() OVER (ORDER BY missing_pct DESC, i) AS INTEGER) AS place, \"column\" "
        f"FROM ({each(DIRTY, GAPS)}) WHERE missing_count > 0"
    ),
)
def missing_by_rank(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    found = eda.missing_columns(m).collect()
    rows = [{"place": k, "column": row["column"]} for k, row in enumerate(found, start=1)]
    return frame(m, rows, "place int, column string")


GAPPY = ("o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "e28_co_missing",
    portable(
        " UNION ALL ".join(
            f"SELECT '{a}' AS col1, '{b}' AS col2, count(*) AS co_missing_count FROM dirty_orders "
            f"WHERE {a} IS NULL AND {b} IS NULL HAVING count(*) > 0"
            for i, a in enumerate(GAPPY) for b in GAPPY[i + 1:]
        )
    ),
)
def co_missing(spark, sf):
    m = metrics_of(spark, sf, "dirty_orders")
    found = eda.co_missing_pairs(m, limit=None)
    m.release()
    return found


HOLES = tuple(f"h{k}" for k in range(2, 9))


@query(
    "g06_ten_co_missing",
    "WITH holes AS (SELECT " + ", ".join(
        f"CASE WHEN o_orderkey % {k} = 0 THEN NULL ELSE o_custkey END AS h{k}" for k in range(2, 9)
    ) + " FROM orders), p AS (" + " UNION ALL ".join(
        f"SELECT {i * 10 + j} AS o, '{a}' AS col1, '{b}' AS col2, "
        f"count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS co_missing_count FROM holes"
        for i, a in enumerate(HOLES) for j, b in enumerate(HOLES) if i < j
    ) + ") SELECT col1, col2, co_missing_count FROM p WHERE co_missing_count > 0 ORDER BY o LIMIT 10",
)
def ten_co_missing(spark, sf):
    orders = table(spark, sf, "orders")
    holes = orders.select(
        *[F.when(F.col("o_orderkey") % k != 0, F.col("o_custkey")).alias(f"h{k}") for k in range(2, 9)]
    )
    m = TableMetrics(holes)
    found = eda.co_missing_pairs(m)
    m.release()
    return found


@query(
    "e29_distinct_rows",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
)
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


# ------------------------------------------------------------------ non-finite numbers


@query(
    "e07_nan_and_infinity",
    "SELECT count(*) FILTER (event_id % 4 <> 1) AS present, count(*) FILTER (event_id % 4 = 1) AS missing, "
    + r("median(CASE event_id % 4 WHEN 0 THEN value WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN -value END)", 4)
    + " AS median FROM events",
)
def nan_and_infinity(spark, sf):
    m = TableMetrics(view(spark, sf, "status_texts").select("reading"))
    [c] = m.columns
    row = {"present": m.count(c), "missing": m.missing(c), "median": m.quartile(c, 0.5)}
    found = frame(m, [row], "present bigint, missing bigint, median double")
    return found.select("present", "missing", *r4("median"))


