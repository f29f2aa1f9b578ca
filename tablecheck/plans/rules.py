"""Weighted checks: which ones apply, whether they pass, and the score they give.

Everything here works on metric frames, whose size follows the number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions.numeric import float_text, round_even

# Meanings for which one single value is fine.
CONSTANT_ALLOWED = (
    "unit", "units", "currency", "country-code", "system-metadata", "status",
    "http_status", "http_method", "boolean",
)

MISSING, CONSTANT = "MissingValueRule", "ConstantColumnRule"
DUPLICATE, ERRORS, TRAFFIC = "DuplicateRowRule", "ErrorRateRule", "TrafficVolumeRule"


@dataclass(frozen=True)
class Limits:
    """Thresholds and weights of the generated rules."""

    max_missing_pct: float = 20.0
    max_duplicate_pct: float = 5.0
    max_error_rate_pct: float = 2.0
    min_rows: int = 100
    missing_weight: float = 20.0
    constant_weight: float = 10.0
    categorical_missing_weight: float = 15.0
    id_missing_weight: float = 30.0
    id_constant_weight: float = 20.0
    duplicate_weight: float = 15.0
    error_weight: float = 10.0
    traffic_weight: float = 5.0


@dataclass(frozen=True)
class Rule:
    """A user check. ``passed`` and ``message`` may use every column of the profile row
    of ``column`` and of the table profile; a table-wide rule leaves ``column`` empty."""

    name: str
    passed: Column
    message: Column
    weight: float
    column: str | None = None


def generate_rules(
    profile: DataFrame, schema: DataFrame, table: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """``(rule_id, rule, column, limit, weight)`` in evaluation order."""
    meaning = schema.select("column", "semantic_type")
    known = profile.select("ordinal", "column").join(F.broadcast(meaning), "column", "left")
    semantic = F.lower(F.trim(F.coalesce("semantic_type", F.lit("unknown"))))
    missing_weight = (
        F.when(semantic == "id-like", limits.id_missing_weight)
        .when(semantic == "categorical", limits.categorical_missing_weight)
        .otherwise(limits.missing_weight)
    )
    constant_weight = F.when(semantic == "id-like", limits.id_constant_weight).otherwise(
        limits.constant_weight
    )
    missing = _rule_struct(0, MISSING, limits.max_missing_pct, missing_weight)
    constant = _rule_struct(1, CONSTANT, 1.0, constant_weight)
    per_column = known.select(
        "ordinal",
        "column",
        F.explode(
            F.when(semantic.isin(*CONSTANT_ALLOWED), F.array(missing)).otherwise(
                F.array(missing, constant)
            )
        ).alias("r"),
    )
    whole = table.select(
        F.lit(2_000_000_000).alias("ordinal"),
        F.lit(None).cast("string").alias("column"),
        F.explode(
            F.filter(
                F.array(
                    _rule_struct(
                        0, DUPLICATE, limits.max_duplicate_pct, limits.duplicate_weight
                    ),
                    F.when(
                        F.col("error_rate_pct").isNotNull(),
                        _rule_struct(
                            1, ERRORS, limits.max_error_rate_pct, limits.error_weight
                        ),
                    ),
                    F.when(
                        F.col("row_count") >= limits.min_rows,
                        _rule_struct(
                            2, TRAFFIC, float(limits.min_rows), limits.traffic_weight
                        ),
                    ),
                ),
                lambda r: r.isNotNull(),
            )
        ).alias("r"),
    )
    rules = per_column.unionByName(whole).select("ordinal", "column", "r.*")
    number = F.row_number().over(Window.orderBy("ordinal", "place"))
    return rules.select(number.alias("rule_id"), "rule", "column", "limit", "weight")


def _rule_struct(place: int, rule: str, limit: float, weight) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.struct(
        F.lit(place).alias("place"),
        F.lit(rule).alias("rule"),
        F.lit(float(limit)).alias("limit"),
        weight.cast("double").alias("weight"),
    )


def _with_metrics(frame: DataFrame, profile: DataFrame, table: DataFrame) -> DataFrame:
    """Rules with the profile of their column and, on every row, the table metrics."""
    of_column = profile.withColumn("found", F.lit(True))
    joined = frame.join(F.broadcast(of_column), "column", "left")
    for name in table.columns:
        joined = joined.withColumn(name, table.select(name).scalar())
    return joined


def evaluate_rules(
    rules: DataFrame,
    profile: DataFrame,
    table: DataFrame,
    custom: list[Rule] | None = None,
) -> DataFrame:
    """``(rule_id, rule, column, passed, message, weight)``."""
    facts = _with_metrics(rules, profile, table)
    column, limit = F.col("column"), F.col("limit")
    unknown = F.concat(F.lit("Column '"), column, F.lit("' not found"))
    missing, unique = F.col("missing_pct"), F.col("unique_count")
    repeated, errors, rows = F.col("duplicate_pct"), F.col("error_rate_pct"), F.col("row_count")

    def outcome(failed: Column, failure: Column, success: Column) -> Column:
        return F.struct(
            (~failed).alias("passed"), F.when(failed, failure).otherwise(success).alias("text")
        )

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    not_found = F.struct(F.lit(False).alias("passed"), unknown.alias("text"))
    no_rate = F.struct(F.lit(False).alias("passed"), F.lit("Error rate missing").alias("text"))
    result = (
        F.when(F.col("rule").isin(MISSING, CONSTANT) & F.col("found").isNull(), not_found)
        .when(
            F.col("rule") == MISSING,
            outcome(
                F.coalesce(missing > limit, F.lit(False)),
                text(column, ": ", float_text(missing), "% missing"),
                text(column, ": missing within limit"),
            ),
        )
        .when(
            F.col("rule") == CONSTANT,
            outcome(
                unique <= 1, text(column, " is constant"), text(column, " varies")
            ),
        )
        .when(
            F.col("rule") == DUPLICATE,
            outcome(
                repeated > limit,
                text(F.format_string("%.2f", repeated), "% duplicate rows"),
                F.lit("Duplicate rows within limit"),
            ),
        )
        .when((F.col("rule") == ERRORS) & errors.isNull(), no_rate)
        .when(
            F.col("rule") == ERRORS,
            outcome(
                errors > limit,
                text("Error rate ", float_text(errors), "%"),
                F.lit("Error rate acceptable"),
            ),
        )
        .when(
            F.col("rule") == TRAFFIC,
            outcome(
                rows < limit,
                text("Only ", rows.cast("string"), " rows"),
                F.lit("Sufficient data volume"),
            ),
        )
    )
    checked = facts.withColumn("result", result).select(
        "rule_id", "rule", "column",
        F.col("result.passed").alias("passed"),
        F.col("result.text").alias("message"),
        "weight",
    )
    if not custom:
        return checked
    return checked.unionByName(_custom_results(rules, profile, table, custom))


def _custom_results(rules, profile, table, custom):
    last = F.coalesce(rules.agg(F.max("rule_id").alias("m")).select("m").scalar(), F.lit(0))
    spark = rules.sparkSession
    parts = None
    for place, rule in enumerate(custom, start=1):
        seed = spark.range(1).select(F.lit(rule.column).cast("string").alias("column"))
        facts = _with_metrics(seed, profile, table)
        missing = F.col("found").isNull() & F.col("column").isNotNull()
        unknown = F.concat(F.lit("Column '"), F.col("column"), F.lit("' not found"))
        one = facts.select(
            (last + place).cast("int").alias("rule_id"),
            F.lit(rule.name).alias("rule"),
            "column",
            F.when(missing, False)
            .otherwise(F.coalesce(rule.passed, F.lit(False)))
            .alias("passed"),
            F.when(missing, unknown).otherwise(rule.message).alias("message"),
            F.lit(float(rule.weight)).alias("weight"),
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


def score(results: DataFrame) -> DataFrame:
    """One row ``(score, status, total_weight, passed_weight)``."""
    total = F.coalesce(F.sum("weight"), F.lit(0.0))
    passed = F.coalesce(F.sum(F.when(F.col("passed"), F.col("weight"))), F.lit(0.0))
    summed = results.agg(
        total.alias("total_weight"), passed.alias("passed_weight"), F.count("*").alias("n")
    )
    ratio = F.try_divide(F.col("passed_weight"), F.col("total_weight"))
    value = F.coalesce(round_even(ratio * 100, 2), F.lit(0.0))
    status = (
        F.when(F.col("n") == 0, "NO_RULES")
        .when(F.col("score") == 100, "PASS")
        .when(F.col("score") >= 70, "WARNING")
        .otherwise("FAIL")
    )
    return summed.withColumn("score", value).select(
        "score", status.alias("status"), "total_weight", "passed_weight"
    )


def failed_rules(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed")).select("rule_id", "rule", "message")


def column_issues(profile: DataFrame) -> DataFrame:
    issue = F.concat(float_text(F.col("missing_pct")), F.lit("% missing values"))
    return profile.where("missing_pct > 0").select("ordinal", "column", issue.alias("issue"))


def top_issues(profile: DataFrame, limit: int = 5) -> DataFrame:
    """Columns with most missing values, by number."""
    worst = column_issues(profile).join(profile.select("column", "missing_pct"), "column")
    return worst.orderBy(F.desc("missing_pct"), "ordinal").limit(limit).select(
        F.concat_ws(": ", "column", "issue").alias("issue")
    )

