"""Pieces of SQL for the expected results, written independently of the Spark code."""

from __future__ import annotations

from dataclasses import dataclass


def r(x: str, digits: int = 2) -> str:
    """Half-even rounding of the scaled value."""
    scale = f"{10 ** digits}.0"
    return f"(round_even(CAST({x} AS DOUBLE) * {scale}, 0) / {scale})"


def pct(part: str, whole: str) -> str:
    return r(f"CAST({part} AS DOUBLE) / {whole} * 100.0")


def number_text(x: str, digits: int = 2) -> str:
    """Decimal text with at least one decimal."""
    return f"regexp_replace(printf('%.{digits}f', {x}), '(\\.\\d+?)0+$', '\\1')"


@dataclass(frozen=True)
class Col:
    name: str
    kind: str
    semantic: str


DIRTY = (
    Col("o_orderkey", "numeric", "numeric"),
    Col("o_custkey", "numeric", "numeric"),
    Col("o_orderstatus", "text", "categorical"),
    Col("o_orderpriority", "text", "categorical"),
    Col("o_totalprice", "numeric", "numeric"),
    Col("constant_col", "text", "categorical"),
    Col("is_even", "boolean", "boolean"),
    Col("o_orderdate", "time", "datetime"),
)
WEB = (
    Col("event_id", "numeric", "numeric"),
    Col("ip", "text", "ip_address"),
    Col("timestamp", "time", "timestamp"),
    Col("method", "text", "http_method"),
    Col("endpoint", "text", "categorical"),
    Col("status", "numeric", "http_status"),
    Col("size", "numeric", "numeric"),
)
LINE = (
    Col("l_orderkey", "numeric", "numeric"),
    Col("l_partkey", "numeric", "numeric"),
    Col("l_suppkey", "numeric", "numeric"),
    Col("l_linenumber", "numeric", "numeric"),
    Col("l_quantity", "numeric", "numeric"),
    Col("l_extendedprice", "numeric", "numeric"),
    Col("l_discount", "numeric", "numeric"),
    Col("l_tax", "numeric", "numeric"),
    Col("l_returnflag", "text", "categorical"),
    Col("l_linestatus", "text", "categorical"),
    Col("l_shipdate", "time", "datetime"),
)


def each(columns, template: str, kinds: tuple[str, ...] | None = None) -> str:
    """``template`` per column, joined by UNION ALL; ``{c}`` name, ``{i}`` ordinal."""
    parts = []
    for i, c in enumerate(columns):
        if kinds is None or c.kind in kinds:
            parts.append(
                template.replace("{c}", f'"{c.name}"').replace("{name}", f"'{c.name}'")
                .replace("{i}", str(i)).replace("{semantic}", f"'{c.semantic}'")
                .replace("{kind}", f"'{c.kind}'")
            )
    return " UNION ALL ".join(parts)


def pairs(columns, template: str) -> str:
    """``template`` per pair ``{a}``, ``{b}`` of numeric columns in table order."""
    numeric = [(i, c) for i, c in enumerate(columns) if c.kind == "numeric"]
    parts = []
    for k, (i, a) in enumerate(numeric):
        for j, b in numeric[k + 1:]:
            parts.append(
                template.replace("{a}", f'"{a.name}"').replace("{b}", f'"{b.name}"')
                .replace("{an}", f"'{a.name}'").replace("{bn}", f"'{b.name}'")
                .replace("{i}", str(i)).replace("{j}", str(j))
            )
    return " UNION ALL ".join(parts)


def facts(view: str, columns, error_rate: bool = False) -> str:
    """CTEs ``prof`` (one row per column) and ``tab`` (one row) for a view."""
    names = ", ".join(f'"{c.name}"' for c in columns)
    parts = []
    for i, c in enumerate(columns):
        q = f'"{c.name}"'
        if c.kind == "numeric":
            stats = (
                f"avg({q}) AS mean, median({q}) AS median, stddev_samp({q}) AS std, "
                f"count(*) FILTER ({q} = 0) AS zeros, "
                f"(SELECT count(*) FROM {view} AS v, (SELECT quantile_cont({q}, 0.25) AS q1, "
                f"quantile_cont({q}, 0.75) AS q3 FROM {view}) AS b "
                f"WHERE v.{q} < q1 - 1.5 * (q3 - q1) OR v.{q} > q3 + 1.5 * (q3 - q1)) AS outliers"
            )
        else:
            stats = (
                "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, "
                "CAST(NULL AS DOUBLE) AS std, CAST(NULL AS BIGINT) AS zeros, "
                "CAST(NULL AS BIGINT) AS outliers"
            )
        parts.append(
            f"SELECT {i} AS ordinal, '{c.name}' AS \"column\", '{c.kind}' AS kind, "
            f"'{c.semantic}' AS semantic, count(*) AS n, count(*) - count({q}) AS missing, "
            f"{pct(f'(count(*) - count({q}))', 'count(*)')} AS missing_pct, "
            f"count(DISTINCT {q}) AS uniq, {stats} FROM {view}"
        )
    rate = "CAST(NULL AS DOUBLE)"
    if error_rate:
        rate = pct("count(*) FILTER (status IN (500, 502, 503))", "count(status)")
    return (
        f"prof AS ({' UNION ALL '.join(parts)}), "
        f"tab AS (SELECT count(*) AS n, {len(columns)} AS width, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {view})) AS dups, "
        f"{rate} AS error_rate FROM {view})"
    )


def rule_results(view: str, columns, error_rate: bool = False) -> str:
    """CTEs up to ``results`` with one row per rule in evaluation order."""
    allowed = (
        "('unit', 'units', 'currency', 'country-code', 'system-metadata', 'status', "
        "'http_status', 'http_method', 'boolean')"
    )
    return f"""
      {facts(view, columns, error_rate)},
      raw_results AS (
        SELECT ordinal * 10 AS o, 'MissingValueRule' AS rule, "column",
          missing_pct <= 20 AS passed,
          CASE WHEN missing_pct > 20 THEN "column" || ': ' || {number_text('missing_pct')} || '% missing'
               ELSE "column" || ': missing within limit' END AS message,
          CASE WHEN semantic = 'categorical' THEN 15.0 ELSE 20.0 END AS weight
        FROM prof
        UNION ALL
        SELECT ordinal * 10 + 1, 'ConstantColumnRule', "column", uniq > 1,
          CASE WHEN uniq > 1 THEN "column" || ' varies' ELSE "column" || ' is constant' END, 10.0
        FROM prof WHERE semantic NOT IN {allowed}
        UNION ALL
        SELECT 10000, 'DuplicateRowRule', NULL, dups * 100.0 / n <= 5,
          CASE WHEN dups * 100.0 / n <= 5 THEN 'Duplicate rows within limit'
               ELSE printf('%.2f', dups * 100.0 / n) || '% duplicate rows' END, 15.0
        FROM tab
        UNION ALL
        SELECT 10001, 'ErrorRateRule', NULL, error_rate <= 2,
          CASE WHEN error_rate <= 2 THEN 'Error rate acceptable'
               ELSE 'Error rate ' || {number_text('error_rate')} || '%' END, 10.0
        FROM tab WHERE error_rate IS NOT NULL
        UNION ALL
        SELECT 10002, 'TrafficVolumeRule', NULL, true, 'Sufficient data volume', 5.0
        FROM tab WHERE n >= 100),
      results AS (
        SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS rule_id, rule, "column",
               passed, message, CAST(weight AS DOUBLE) AS weight
        FROM raw_results),
      scored AS (
        SELECT {r('coalesce(sum(weight) FILTER (passed), 0) / sum(weight) * 100.0')} AS score,
               sum(weight) AS total_weight,
               coalesce(sum(weight) FILTER (passed), 0) AS passed_weight FROM results),
      score AS (
        SELECT score, CASE WHEN score = 100 THEN 'PASS' WHEN score >= 70 THEN 'WARNING'
                           ELSE 'FAIL' END AS status, total_weight, passed_weight FROM scored)
    """
