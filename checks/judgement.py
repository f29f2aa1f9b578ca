"""Rules, score, recommendations, insights, reports and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.statements import (
    DIRTY, LINE, WEB, each, facts, number_text, pct, r, rule_results,
)
from checks.statistics import LINKED, LINKED_NAMES, linked
from checks.views import portable, scratch_folder, table, view
from tablecheck import Limits, Rule, TableMetrics, quality_report
from tablecheck.functions import numeric, text, timestamps
from tablecheck.plans import accuracy, eda, recommend, rules, wording
from tablecheck.session import small_frame


def report(spark, sf, name="dirty_orders", **options):
    return quality_report(view(spark, sf, name), **options)


def finished(found, frame):
    """A section's frame is on the driver by now; the kept input can go."""
    found.metrics.release()
    return frame


def results_sql(select):
    """``select`` over the rule results of three tables."""
    parts = []
    for source, columns, rate in (
        ("dirty_orders", DIRTY, False), ("very_dirty_orders", DIRTY, False), ("web_log", WEB, True),
    ):
        parts.append(
            f"SELECT * FROM (WITH {rule_results(source, columns, rate)} "
            f"SELECT '{source}' AS source, {select})"
        )
    return portable(" UNION ALL ".join(parts))


def over_three(spark, sf, section):
    found = []
    for name in ("dirty_orders", "very_dirty_orders", "web_log"):
        one = report(spark, sf, name)
        rows = section(one)
        one.metrics.release()
        found.append(rows.select(F.lit(name).alias("source"), *rows.columns))
    return found[0].unionByName(found[1]).unionByName(found[2])


# ------------------------------------------------------------------ rules and score


@query("j06_generated_rules", results_sql("rule_id, rule, \"column\", weight FROM results"))
def generated_rules(spark, sf):
    return over_three(spark, sf, lambda one: one.rules.drop("limit"))


@query("j07_rule_results", results_sql("rule_id, rule, \"column\", passed, message, weight FROM results"))
def all_results(spark, sf):
    return over_three(spark, sf, lambda one: one.rule_results)


@query("e30_score", results_sql("score, status, total_weight, passed_weight FROM score"))
def score(spark, sf):
    return over_three(spark, sf, lambda one: one.score)


@query("c05_failed_rules", results_sql("rule_id, rule, message FROM results WHERE NOT passed"))
def failed_rules(spark, sf):
    return over_three(spark, sf, lambda one: one.failed_rules)


def one_rule(name, kind):
    where = f"\"column\", passed, message FROM results WHERE rule = '{kind}'"

    @query(name, results_sql(where))
    def run(spark, sf):
        return over_three(
            spark, sf,
            lambda one: one.rule_results.where(F.col("rule") == kind).select(
                "column", "passed", "message"
            ),
        )

    return run


one_rule("j01_missing_rule", rules.MISSING)
one_rule("j02_duplicate_rule", rules.DUPLICATE)
one_rule("j03_error_rate_rule", rules.ERRORS)
one_rule("j05_constant_rule", rules.CONSTANT)


@query(
    "j04_traffic_rule",
    "SELECT count(*) >= 1000000 AS passed, CASE WHEN count(*) >= 1000000 THEN 'Sufficient data volume' "
    "ELSE 'Only ' || count(*) || ' rows' END AS message FROM orders",
)
def traffic_rule(spark, sf):
    one = quality_report(table(spark, sf, "orders"), limits=Limits(min_rows=1_000_000))
    only = small_frame(
        spark,
        [{"rule_id": 1, "rule": rules.TRAFFIC, "column": None, "limit": 1e6, "weight": 5.0}],
        "rule_id int, rule string, column string, limit double, weight double",
    )
    checked = rules.evaluate_rules(only, one.column_profile, one.table_profile)
    return finished(one, checked.select("passed", "message"))


@query(
    "j08_custom_rules",
    portable(
        f"WITH {facts('dirty_orders', DIRTY)} "
        "SELECT 'PriceRange' AS rule, 'o_totalprice' AS \"column\", "
        "(SELECT max(o_totalprice) FROM dirty_orders) <= 1000000 AS passed, 'max price' AS message, 7.0 AS weight "
        "UNION ALL SELECT 'EnoughRows', NULL, n > 10, 'rows ' || n, 3.0 FROM tab "
        "UNION ALL SELECT 'Unknown', 'nope', false, 'Column ''nope'' not found', 1.0"
    ),
)
def custom_rules(spark, sf):
    extra = [
        Rule("PriceRange", F.col("max") <= 1_000_000, F.lit("max price"), 7.0, "o_totalprice"),
        Rule("EnoughRows", F.col("row_count") > 10,
             F.concat(F.lit("rows "), F.col("row_count").cast("string")), 3.0),
        Rule("Unknown", F.lit(True), F.lit("never"), 1.0, "nope"),
    ]
    one = report(spark, sf, custom_rules=extra)
    found = one.rule_results.where(F.col("rule").isin("PriceRange", "EnoughRows", "Unknown"))
    return finished(one, found.drop("rule_id"))


@query(
    "c06_column_issues",
    portable(
        f"WITH {facts('dirty_orders', DIRTY)} SELECT \"column\", {number_text('missing_pct')} "
        "|| '% missing values' AS issue FROM prof WHERE missing_pct > 0"
    ),
)
def column_issues(spark, sf):
    one = report(spark, sf)
    return finished(one, one.column_issues.drop("ordinal"))


@query(
    "g07_top_issues",
    portable(
        f"WITH {facts('dirty_orders', DIRTY)} SELECT \"column\" || ': ' || {number_text('missing_pct')} "
        "|| '% missing values' AS issue FROM prof WHERE missing_pct > 0 ORDER BY missing_pct DESC, ordinal LIMIT 5"
    ),
)
def top_issues(spark, sf):
    one = report(spark, sf)
    return finished(one, rules.top_issues(one.column_profile))


@query(
    "d01_metric_lookup",
    portable(
        f"WITH {facts('web_log', WEB)} SELECT \"column\", missing_pct, "
        "CASE WHEN \"column\" = 'size' THEN 'unknown' ELSE semantic END AS semantic_type FROM prof"
    ),
)
def metric_lookup(spark, sf):
    one = report(spark, sf, "web_log")
    meaning = one.column_schema.select("column", "semantic_type").where("column <> 'size'")
    joined = one.column_profile.join(F.broadcast(meaning), "column", "left")
    semantic = F.coalesce("semantic_type", F.lit("unknown")).alias("semantic_type")
    return finished(one, joined.select("column", "missing_pct", semantic))


# ------------------------------------------------------------------ recommendations


def filled(template, **values):
    """A template as a SQL expression, from the published wording."""
    out = "'" + template.replace("'", "''") + "'"
    for name, sql in values.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


def recommendation_rows():
    column, gap = '"column"', number_text("missing_pct")
    out_pct = pct("outliers", "n")
    zero_pct = pct("zeros", "n")
    average = "CASE WHEN semantic = 'numeric' THEN 'median' ELSE 'mode' END"
    mean, median = number_text(r("mean", 2)), number_text(r("median", 2))
    by = "CASE WHEN missing_pct > 50 THEN {0} WHEN missing_pct > 20 THEN {1} ELSE {2} END"
    medium = (
        f"CASE WHEN semantic = 'numeric' THEN {filled(wording.MISSING_MEDIUM_NUMERIC, column=column)} "
        f"ELSE {filled(wording.MISSING_MEDIUM_OTHER, column=column)} END"
    )
    high = [filled(t, column=column, missing_pct=gap) for t in wording.MISSING_HIGH]
    low = [filled(t, column=column, missing_pct=gap, average=average) for t in wording.MISSING_LOW]
    mid = filled(wording.MISSING_MEDIUM_IMPACT, column=column, missing_pct=gap)
    outlier = [
        filled(t, column=column, outlier_count="outliers", outlier_pct=number_text(out_pct),
               mean=mean, median=median)
        for t in wording.OUTLIERS
    ]
    constant = [filled(t, column=column) for t in wording.CONSTANT]
    many = [filled(t, column=column) for t in wording.CARDINALITY]
    zeros = [filled(t, column=column, zero_pct=number_text(zero_pct)) for t in wording.ZEROS]
    dup_pct = pct("dups", "n")
    dup = [filled(t, duplicate_rows="dups", duplicate_pct=number_text(dup_pct)) for t in wording.DUPLICATES]
    errors = [filled(t, error_rate_pct=number_text("error_rate")) for t in wording.ERROR_RATE]
    return f"""
      recs AS (
        SELECT ordinal * 10 AS o, "column", 'Missing Values' AS issue,
          {by.format("'HIGH'", "'MEDIUM'", "'LOW'")} AS severity,
          {by.format(high[0], mid, low[0])} AS business_impact,
          {by.format(high[1], medium, low[1])} AS recommendation,
          {by.format("'DROP_OR_INVESTIGATE'", "'IMPUTE'", "'IMPUTE'")} AS action
        FROM prof WHERE missing_pct > 0
        UNION ALL SELECT ordinal * 10 + 1, "column", 'Outliers Detected',
          CASE WHEN {out_pct} > 5 THEN 'MEDIUM' ELSE 'LOW' END, {outlier[0]}, {outlier[1]}, 'INVESTIGATE_OUTLIERS'
        FROM prof WHERE outliers > 0
        UNION ALL SELECT ordinal * 10 + 2, "column", 'Constant Column', 'MEDIUM', {constant[0]}, {constant[1]}, 'DROP_COLUMN'
        FROM prof WHERE uniq <= 1 AND semantic NOT IN ('http_status', 'http_method', 'boolean', 'status')
        UNION ALL SELECT ordinal * 10 + 3, "column", 'High Cardinality', 'LOW', {many[0]}, {many[1]}, 'REVIEW_COLUMN'
        FROM prof WHERE semantic = 'categorical' AND uniq > 0.9 * n
        UNION ALL SELECT ordinal * 10 + 4, "column", 'High Zero Count', 'LOW', {zeros[0]}, {zeros[1]}, 'VERIFY_ZEROS'
        FROM prof WHERE zeros > 0 AND semantic = 'numeric' AND {zero_pct} > 10
        UNION ALL SELECT 10000, 'DATASET', 'Duplicate Rows', CASE WHEN {dup_pct} > 5 THEN 'HIGH' ELSE 'MEDIUM' END,
          {dup[0]}, {dup[1]}, 'DROP_DUPLICATES' FROM tab WHERE dups > 0
        UNION ALL SELECT 10001, 'LOG_METRICS', 'High Error Rate', 'HIGH', {errors[0]}, {errors[1]}, 'INVESTIGATE_ERRORS'
        FROM tab WHERE error_rate > 2)
    """


def recs_sql(source, columns, where="true", rate=False,
             select='"column", issue, severity, business_impact, recommendation, action'):
    return portable(
        f"WITH {facts(source, columns, rate)}, {recommendation_rows()} SELECT {select} FROM recs WHERE {where}"
    )


def one_issue(name, issue, source, columns, rate=False):
    @query(name, recs_sql(source, columns, f"issue = '{issue}'", rate))
    def run(spark, sf):
        one = report(spark, sf, source)
        return finished(one, one.recommendations.where(F.col("issue") == issue))

    return run


one_issue("k01_missing_advice", "Missing Values", "dirty_orders", DIRTY)
one_issue("k02_outlier_advice", "Outliers Detected", "dirty_orders", DIRTY)
one_issue("k03_constant_advice", "Constant Column", "dirty_orders", DIRTY)
one_issue("k05_zero_advice", "High Zero Count", "dirty_orders", DIRTY)
one_issue("k06_duplicate_advice", "Duplicate Rows", "very_dirty_orders", DIRTY)
one_issue("k07_error_advice", "High Error Rate", "web_log", WEB, True)


@query(
    "k04_cardinality_advice",
    "SELECT 'c_name' AS \"column\", 'High Cardinality' AS issue, 'LOW' AS severity, "
    + filled(wording.CARDINALITY[0], column="'c_name'") + " AS business_impact, "
    + filled(wording.CARDINALITY[1], column="'c_name'") + " AS recommendation, 'REVIEW_COLUMN' AS action "
    "FROM customer HAVING count(DISTINCT c_name) > 0.9 * count(*)",
)
def cardinality_advice(spark, sf):
    one = report(spark, sf, "customer")
    return finished(one, one.recommendations.where("issue = 'High Cardinality'"))


@query(
    "k00_recommendations_in_order",
    recs_sql("web_log", WEB, rate=True,
             select='CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS place, "column", issue'),
)
def recommendations_in_order(spark, sf):
    one = report(spark, sf, "web_log")
    rows = [
        {"place": k, "column": row["column"], "issue": row["issue"]}
        for k, row in enumerate(one.recommendations.collect(), start=1)
    ]
    return finished(one, small_frame(spark, rows, "place int, column string, issue string"))


@query(
    "c07_findings_by_severity",
    portable(
        f"WITH {facts('dirty_orders', DIRTY)}, {recommendation_rows()} "
        "SELECT severity, count(*) AS findings FROM recs GROUP BY severity"
    ),
)
def findings_by_severity(spark, sf):
    one = report(spark, sf)
    return finished(one, recommend.findings_by_severity(one.recommendations))


def summary_sql(source, columns, rate=False):
    count = "(SELECT count(*) FROM recs WHERE severity = '{}')"
    parts = [
        "'Dataset contains ' || format('{:,}', n) || ' rows and ' || width || ' columns.'",
        "'Overall Data Quality Score: ' || " + number_text("score") + " || '/100 — ' || status || '.'",
        f"CASE status WHEN 'PASS' THEN '{wording.SUMMARY_STATE['PASS']}' "
        f"WHEN 'WARNING' THEN '{wording.SUMMARY_STATE['WARNING']}' ELSE '{wording.SUMMARY_STATE['other']}' END",
        "CASE WHEN dups > 0 THEN 'Found ' || dups || ' duplicate rows that should be removed.' END",
    ]
    for level, tail in (
        ("HIGH", "critical issue(s) require immediate attention."),
        ("MEDIUM", "moderate issue(s) should be reviewed."),
        ("LOW", "minor issue(s) flagged for awareness."),
    ):
        n = count.format(level)
        parts.append(f"CASE WHEN {n} > 0 THEN {n} || ' {tail}' END")
    return (
        f"SELECT * FROM (WITH {rule_results(source, columns, rate)}, {recommendation_rows()} "
        f"SELECT concat_ws(' ', {', '.join(parts)}) AS summary FROM tab, score)"
    )


@query(
    "k08_summary",
    portable(summary_sql("dirty_orders", DIRTY) + " UNION ALL " + summary_sql("web_log", WEB, True)),
)
def summary(spark, sf):
    return (
        report(spark, sf).summary.unionByName(report(spark, sf, "web_log").summary)
    )


# ------------------------------------------------------------------ insights


@query(
    "k09_missing_insight",
    portable(
        f"WITH {facts('dirty_orders', DIRTY)} SELECT '''' || \"column\" || ''' has the highest missing rate (' || "
        + number_text(r("missing * 100.0 / n", 1), 1)
        + " || '%).' AS insight FROM prof ORDER BY missing DESC, ordinal LIMIT 1"
    ),
)
def missing_insight(spark, sf):
    one = report(spark, sf)
    return finished(one, one.insights.where("type = 'missing'").select("insight"))


def linked_correlations():
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM linked"
        for i, a in enumerate(LINKED_NAMES) for b in LINKED_NAMES[i + 1:]
    )


@query(
    "k10_correlation_insight",
    f"WITH linked AS ({LINKED}), p AS ({linked_correlations()}) SELECT "
    + filled(
        wording.INSIGHT_CORRELATION,
        sign="CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END",
        r=number_text(r("c", 2)), a="a", b="b",
    )
    + " AS insight FROM p WHERE abs(c) > 0.8",
)
def correlation_insight(spark, sf):
    m = TableMetrics(linked(spark, sf))
    found = eda.insights(m).where("type = 'correlation'").select("insight")
    m.release()
    return found


SKEWED = "SELECT {name} AS col, skewness({c}) AS g, count({c}) AS n FROM dirty_orders"


@query(
    "k11_skewness_insight",
    portable(
        "SELECT " + filled(
            wording.INSIGHT_SKEW, column="col",
            side="CASE WHEN g > 0 THEN 'right' ELSE 'left' END", skewness=number_text(r("g", 2)),
        )
        + f" AS insight FROM ({each(DIRTY, SKEWED, ('numeric',))}) WHERE n > 10 AND abs(g) > 2"
    ),
)
def skewness_insight(spark, sf):
    one = report(spark, sf)
    return finished(one, one.insights.where("type = 'distribution'").select("insight"))


@query(
    "k12_variance_insight",
    "WITH t AS (SELECT stddev_samp(1000000 + l_linenumber) / abs(avg(1000000 + l_linenumber)) AS cv FROM lineitem) "
    "SELECT " + filled(wording.INSIGHT_VARIANCE, column="'base'", cv=number_text(r("cv", 4), 4))
    + " AS insight FROM t WHERE cv < 0.01",
)
def variance_insight(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.lit(1_000_000) + F.col("l_linenumber")).alias("base"), "l_quantity",
        (F.lit(1_000_000) + F.col("l_linenumber")).alias("status"),
    )
    m = TableMetrics(rows)
    found = eda.insights(m).where("type = 'variance'").select("insight")
    m.release()
    return found


# ------------------------------------------------------------------ reports


@query(
    "c08_column_card",
    portable(
        f"WITH {facts('dirty_orders', DIRTY)} SELECT \"column\", n - missing AS present, "
        f"{r('mean', 4)} AS mean, outliers, CAST(NULL AS DOUBLE) AS entropy, CAST(NULL AS VARCHAR) AS issue "
        "FROM prof WHERE \"column\" = 'o_totalprice' UNION ALL "
        f"SELECT \"column\", NULL, NULL, NULL, (SELECT {r('entropy(o_orderpriority)', 4)} FROM dirty_orders "
        f"WHERE o_orderpriority IS NOT NULL), {number_text('missing_pct')} || '% missing values' "
        "FROM prof WHERE \"column\" = 'o_orderpriority'"
    ),
)
def column_card(spark, sf):
    one = report(spark, sf)
    cards = eda.column_card(one, "o_totalprice").unionByName(eda.column_card(one, "o_orderpriority"))
    found = cards.select(
        "column", F.col("numeric.count").alias("present"), F.col("numeric.mean").alias("mean"),
        F.col("outliers.count").alias("outliers"), F.col("categorical.entropy").alias("entropy"),
        F.col("issue.issue").alias("issue"),
    )
    return finished(one, found)


@query(
    "b01_json_safe",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 3 THEN -value END AS reading FROM events",
)
def json_safe(spark, sf):
    rows = view(spark, sf, "status_texts")
    return rows.select("event_id", numeric.json_safe(F.col("reading")).alias("reading"))


@query("b02_report")
def whole_report(spark, sf):
    one = report(spark, sf, "web_log", order_by="event_id")
    return finished(one, one.as_json())


@query(
    "b02_report_head",
    portable(
        f"WITH {rule_results('dirty_orders', DIRTY)} SELECT n AS row_count, score, status, "
        "(SELECT count(*) FROM results WHERE NOT passed) AS failed, width AS columns FROM tab, score"
    ),
)
def report_head(spark, sf):
    one = report(spark, sf)
    row = one.as_frame()
    return finished(one, row.select(
        "table.row_count", "quality_score.score", "quality_score.status",
        F.size("failed_rules").cast("bigint").alias("failed"),
        F.col("table.column_count").alias("columns"),
    ))


@query(
    "b02_report_file",
    portable("SELECT count(*) AS row_count FROM web_log"),
)
def report_file(spark, sf):
    folder = scratch_folder(spark)
    one = report(spark, sf, "web_log")
    one.write_json(folder)
    one.metrics.release()
    return spark.read.json(folder).select("table.row_count")


@query(
    "b03_source_tag",
    "SELECT 'catalog' AS type, 'main' AS db_path, 'supplier' AS table_name, count(*) AS row_count FROM supplier",
)
def source_tag(spark, sf):
    tag = {"type": "catalog", "db_path": "main", "table_name": "supplier"}
    one = report(spark, sf, "supplier", source=tag)
    return finished(one, one.as_frame().select("source.*", "table.row_count"))


# ------------------------------------------------------------------ scalar functions


@query(
    "i01_string_functions",
    "SELECT event_id, trim(concat('  ', event_type, ' ')) AS trimmed, lower(upper(event_type)) AS lowered, "
    "starts_with(event_type, 'c') AS starts, contains(event_type, 'ie') AS contains, "
    "regexp_extract(props, '([0-9]+)', 1) AS digits, string_split(props, ':')[1] AS head FROM events",
)
def string_functions(spark, sf):
    kind, props = F.col("event_type"), F.col("props")
    return table(spark, sf, "events").select(
        "event_id", text.stripped(F.concat(F.lit(" \t"), kind, F.lit("\r "))).alias("trimmed"),
        F.lower(F.upper(kind)).alias("lowered"), kind.startswith("c").alias("starts"),
        kind.contains("ie").alias("contains"), F.regexp_extract(props, "([0-9]+)", 1).alias("digits"),
        F.get(F.split(props, ":"), F.lit(0)).alias("head"),
    )


@query(
    "i02_numeric_coercion",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 999 WHEN 4 THEN 200.0 WHEN 5 THEN 404 END::DOUBLE AS number, "
    "event_id % 6 IN (0, 5) AS valid FROM events",
)
def numeric_coercion(spark, sf):
    rows = view(spark, sf, "status_texts")
    return rows.select(
        "event_id", numeric.numeric_or_null(F.col("status")).alias("number"),
        text.is_valid_http_status(F.col("status"), "string").alias("valid"),
    )


@query(
    "i03_time_functions",
    "SELECT event_id, date_trunc('second', ts) AS parsed, CAST(CAST(ts AS DATE) AS VARCHAR) AS day "
    "FROM events WHERE event_id % 37 <> 0",
)
def time_functions(spark, sf):
    from tablecheck.sources.logs import parse_log

    rows = parse_log(view(spark, sf, "log_lines"), "apache_combined", ("event_id",))
    parsed = timestamps.parse_any(F.col("timestamp"), "string")
    return rows.where("ip is not null").select(
        "event_id", parsed.cast("timestamp_ntz").alias("parsed"),
        F.to_date(parsed).cast("string").alias("day"),
    )


@query(
    "i04_math_functions",
    f"SELECT event_id, {r('value / 7.0')} AS rounded, abs(-value) AS magnitude, "
    f"{r('sqrt(value)', 6)} AS root, {r('log2(value + 1)', 6)} AS bits, "
    f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE {r('value / (event_id % 3) * 100')} END AS share, "
    "least(value, 5.0) AS low, greatest(value, 5.0) AS high FROM events",
)
def math_functions(spark, sf):
    value = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", numeric.round_even(value / 7.0, 2).alias("rounded"), F.abs(-value).alias("magnitude"),
        numeric.round_even(F.sqrt(value), 6).alias("root"),
        numeric.round_even(F.log2(value + 1), 6).alias("bits"),
        numeric.percent(value, F.col("event_id") % 3).alias("share"),
        F.least(value, F.lit(5.0)).alias("low"), F.greatest(value, F.lit(5.0)).alias("high"),
    )


@query(
    "i04_bias_corrected_moments",
    "SELECT event_type, " + r("skewness(value)", 4) + " AS skewness, " + r("kurtosis(value)", 4)
    + " AS kurtosis FROM events GROUP BY event_type",
)
def bias_corrected_moments(spark, sf):
    n = F.count("value")
    g = numeric.bias_corrected_skewness(F.skewness("value"), n)
    k = numeric.bias_corrected_kurtosis(F.kurtosis("value"), n)
    return table(spark, sf, "events").groupBy("event_type").agg(
        numeric.round_even(g, 4).alias("skewness"), numeric.round_even(k, 4).alias("kurtosis")
    )


@query(
    "i05_formatting",
    f"SELECT o_orderkey, printf('%.2f', o_totalprice) || '%' AS fixed, format('{{:,}}', o_orderkey * 1000) AS grouped, "
    f"{number_text('o_totalprice')} AS short FROM orders",
)
def formatting(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key, F.format_string("%.2f%%", price).alias("fixed"),
        F.format_number(key * 1000, 0).alias("grouped"), numeric.float_text(price).alias("short"),
    )


@query(
    "i06_json_functions",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract(props, '$.k') || '}' AS again FROM events",
)
def json_functions(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again")
    )


@query(
    "i07_null_defaults",
    portable("SELECT o_orderkey, o_custkey IS NULL AS missing, coalesce(o_custkey, -1) AS filled FROM dirty_base"),
)
def null_defaults(spark, sf):
    key = F.col("o_custkey")
    return view(spark, sf, "dirty_base").select(
        "o_orderkey", key.isNull().alias("missing"), F.coalesce(key, F.lit(-1)).alias("filled")
    )


@query(
    "i08_numeric_text",
    "SELECT o_orderkey, true AS price, false AS priority, o_orderkey % 2 = 0 AS mixed FROM orders",
)
def numeric_text(spark, sf):
    key = F.col("o_orderkey").cast("string")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), key, F.lit(".5"))).otherwise(
        F.concat(key, F.lit("x"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", text.is_number_text(F.col("o_totalprice").cast("string")).alias("price"),
        text.is_number_text(F.col("o_orderpriority")).alias("priority"),
        text.is_number_text(mixed).alias("mixed"),
    )


# ------------------------------------------------------------------ accuracy

DEFECTS = accuracy.Defects("o_custkey", 150, 40, "o_totalprice", 25, (-5_000_000.0, 9_990_000.0))


def damaged(spark, sf):
    return accuracy.inject_defects(table(spark, sf, "orders"), "o_orderkey", DEFECTS)


@query(
    "l01_planted_defects",
    "SELECT count(*) + 40 AS rows, 150 AS missing, 40 AS duplicates, 25 AS outliers, "
    "'constant_col' AS constant_column FROM orders",
)
def planted_defects(spark, sf):
    return accuracy.planted_counts(damaged(spark, sf), DEFECTS)


@query(
    "l02_detected_defects",
    """SELECT 'missing' AS defect, 150 AS planted, 150 AS detected, true AS matched, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall
       UNION ALL SELECT 'duplicates', 40, 40, true, NULL, NULL
       UNION ALL SELECT 'constant', 1, 1, true, NULL, NULL
       UNION ALL SELECT 'outliers', 25, 25, true, 1.0, 1.0""",
)
def detected_defects(spark, sf):
    return accuracy.detection_report(damaged(spark, sf), DEFECTS)


@query(
    "l03_known_figures",
    portable(
        f"WITH {facts('dirty_orders', DIRTY)} SELECT 'rows' AS figure, 15600.0 AS known, n::DOUBLE AS found, "
        "abs(n - 15600) <= 156 AS within FROM tab UNION ALL "
        "SELECT 'duplicate_rows', 600.0, dups, abs(dups - 600) <= 6 FROM tab UNION ALL "
        "SELECT 'missing_pct:o_custkey', 30.77, missing_pct, abs(missing_pct - 30.77) <= 0.3077 "
        "FROM prof WHERE \"column\" = 'o_custkey' UNION ALL "
        "SELECT 'missing_pct:o_orderstatus', 24.9, missing_pct, abs(missing_pct - 24.9) <= 0.249 "
        "FROM prof WHERE \"column\" = 'o_orderstatus'"
    ),
)
def known_figures(spark, sf):
    m = TableMetrics(view(spark, sf, "dirty_orders"))
    known = {
        "rows": 15600, "duplicate_rows": 600,
        "missing_pct:o_custkey": 30.77, "missing_pct:o_orderstatus": 24.9,
    }
    found = accuracy.compare_with_known(m, known)
    m.release()
    return found


@query(
    "l04_expectations",
    portable(
        each(DIRTY, "SELECT {name} AS \"column\", 'not_null' AS expectation, count(*) - count({c}) AS failing_rows, "
                    "count(*) = count({c}) AS passed FROM dirty_orders")
        + " UNION ALL "
        + each(DIRTY, "SELECT {name}, 'in_range', 0, true", ("numeric",))
        + " UNION ALL SELECT 'limited', 'in_range', count(*) FILTER (o_totalprice NOT BETWEEN 10 AND 400000), "
        "count(*) FILTER (o_totalprice NOT BETWEEN 10 AND 400000) = 0 FROM dirty_orders"
    ),
)
def expectations(spark, sf):
    rows = view(spark, sf, "dirty_orders")
    own = accuracy.expectations(rows)
    limited = accuracy.expectations(
        rows.select(F.col("o_totalprice").alias("limited")), {"limited": (10, 400_000)}
    ).where("expectation = 'in_range'")
    return own.unionByName(limited).drop("ordinal")


@query(
    "b02_lineitem_score",
    f"WITH {rule_results('lineitem', LINE)} SELECT score, status, total_weight, passed_weight FROM score",
)
def lineitem_score(spark, sf):
    one = report(spark, sf, "lineitem")
    return finished(one, one.score)
