"""Advice from metrics: what to do about each finding, and a summary in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.numeric import float_text, percent, round_even
from tablecheck.plans import wording

# Meanings whose constant columns need no advice.
CONSTANT_EXPECTED = ("http_status", "http_method", "boolean", "status")

FIELDS = ("column", "issue", "severity", "business_impact", "recommendation", "action")


def _finding(place, when, issue, severity, impact, advice, action) -> Column:
    values = {
        "issue": F.lit(issue),
        "severity": severity if isinstance(severity, Column) else F.lit(severity),
        "business_impact": impact,
        "recommendation": advice,
        "action": action if isinstance(action, Column) else F.lit(action),
    }
    struct = F.struct(
        F.lit(place).alias("place"), *[v.alias(k) for k, v in values.items()]
    )
    return F.when(when, struct)


def _exploded(frame: DataFrame, findings: list[Column]) -> DataFrame:
    present = F.filter(F.array(*findings), lambda f: f.isNotNull())
    return frame.select("ordinal", "column", F.explode(present).alias("f")).select(
        "ordinal", "column", "f.*"
    )


def recommendations(profile: DataFrame, schema: DataFrame, table: DataFrame) -> DataFrame:
    """Findings in order: column by column, then the whole table, then log metrics."""
    meaning = schema.select("column", "semantic_type")
    rows = table.select("row_count").scalar()
    facts = profile.join(F.broadcast(meaning), "column", "left").withColumn("rows", rows)
    per_column = _exploded(facts, _column_findings())
    whole = table.select("*", F.lit(2_000_000_000).alias("ordinal"))
    dataset = _exploded(
        whole.withColumn("column", F.lit("DATASET")), [_duplicate_finding()]
    )
    logs = _exploded(
        whole.withColumn("column", F.lit("LOG_METRICS")), [_error_finding()]
    )
    found = per_column.unionByName(dataset).unionByName(logs)
    return found.orderBy("ordinal", "place").select(*FIELDS)


def _column_findings() -> list[Column]:
    column = F.col("column")
    semantic = F.lower(F.trim(F.coalesce("semantic_type", F.lit("unknown"))))
    is_numeric = semantic == "numeric"
    missing = F.coalesce("missing_pct", F.lit(0.0))
    filled = {"column": column, "missing_pct": float_text(missing)}
    average = F.when(is_numeric, "median").otherwise("mode")
    high = [wording.sentence(t, **filled) for t in wording.MISSING_HIGH]
    low = [wording.sentence(t, average=average, **filled) for t in wording.MISSING_LOW]
    medium_impact = wording.sentence(wording.MISSING_MEDIUM_IMPACT, **filled)
    medium_advice = F.when(
        is_numeric, wording.sentence(wording.MISSING_MEDIUM_NUMERIC, column=column)
    ).otherwise(wording.sentence(wording.MISSING_MEDIUM_OTHER, column=column))

    def by_rate(above_half, above_fifth, otherwise) -> Column:
        def literal(v):
            return v if isinstance(v, Column) else F.lit(v)

        return (
            F.when(missing > 50, literal(above_half))
            .when(missing > 20, literal(above_fifth))
            .otherwise(literal(otherwise))
        )

    outlier_pct = percent(F.col("outlier_count"), F.col("rows"))
    outliers = [
        wording.sentence(
            t,
            column=column,
            outlier_count=F.col("outlier_count"),
            outlier_pct=float_text(outlier_pct),
            mean=F.coalesce(float_text(round_even(F.col("mean"), 2)), F.lit("nan")),
            median=F.coalesce(float_text(round_even(F.col("median"), 2)), F.lit("nan")),
        )
        for t in wording.OUTLIERS
    ]
    zero_pct = percent(F.col("zero_count"), F.col("rows"))
    unique = F.col("unique_count")
    return [
        _finding(
            0, missing > 0, "Missing Values",
            by_rate("HIGH", "MEDIUM", "LOW"),
            by_rate(high[0], medium_impact, low[0]),
            by_rate(high[1], medium_advice, low[1]),
            by_rate("DROP_OR_INVESTIGATE", "IMPUTE", "IMPUTE"),
        ),
        _finding(
            1, F.col("outlier_count") > 0, "Outliers Detected",
            F.when(outlier_pct > 5, "MEDIUM").otherwise("LOW"),
            *outliers, "INVESTIGATE_OUTLIERS",
        ),
        _finding(
            2, (unique <= 1) & ~semantic.isin(*CONSTANT_EXPECTED), "Constant Column",
            "MEDIUM",
            *[wording.sentence(t, column=column) for t in wording.CONSTANT],
            "DROP_COLUMN",
        ),
        _finding(
            3, (semantic == "categorical") & (unique > F.col("rows") * 0.9),
            "High Cardinality", "LOW",
            *[wording.sentence(t, column=column) for t in wording.CARDINALITY],
            "REVIEW_COLUMN",
        ),
        _finding(
            4, (F.col("zero_count") > 0) & is_numeric & (zero_pct > 10),
            "High Zero Count", "LOW",
            *[
                wording.sentence(t, column=column, zero_pct=float_text(zero_pct))
                for t in wording.ZEROS
            ],
            "VERIFY_ZEROS",
        ),
    ]


def _duplicate_finding() -> Column:
    pct = percent(F.col("duplicate_rows"), F.col("row_count"))
    texts = [
        wording.sentence(
            t, duplicate_rows=F.col("duplicate_rows"), duplicate_pct=float_text(pct)
        )
        for t in wording.DUPLICATES
    ]
    return _finding(
        5, F.col("duplicate_rows") > 0, "Duplicate Rows",
        F.when(pct > 5, "HIGH").otherwise("MEDIUM"), *texts, "DROP_DUPLICATES",
    )


def _error_finding() -> Column:
    rate = F.col("error_rate_pct")
    texts = [
        wording.sentence(t, error_rate_pct=float_text(rate)) for t in wording.ERROR_RATE
    ]
    return _finding(
        6, rate > 2, "High Error Rate", "HIGH", *texts, "INVESTIGATE_ERRORS"
    )


def findings_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def summary(table: DataFrame, score: DataFrame, findings: DataFrame) -> DataFrame:
    """One row with the executive summary."""

    def of_table(name):
        return table.select(name).scalar()

    counts = findings.agg(
        *[
            F.count_if(F.col("severity") == s).alias(s.lower())
            for s in ("HIGH", "MEDIUM", "LOW")
        ],
        F.count("*").alias("all_findings"),
    )
    facts = (
        score.withColumn("rows", of_table("row_count"))
        .withColumn("columns", of_table("column_count"))
        .withColumn("duplicates", of_table("duplicate_rows"))
    )
    for name in counts.columns:
        facts = facts.withColumn(name, counts.select(name).scalar())
    state = F.lit(wording.SUMMARY_STATE["other"])
    for status in ("WARNING", "PASS"):
        state = F.when(F.col("status") == status, wording.SUMMARY_STATE[status]).otherwise(
            state
        )

    def when_any(name, template, **values):
        return F.when(F.col(name) > 0, wording.sentence(template, **values))

    text = F.concat_ws(
        " ",
        wording.sentence(
            wording.SUMMARY_SIZE,
            rows=F.format_number("rows", 0), columns=F.col("columns"),
        ),
        wording.sentence(
            wording.SUMMARY_SCORE, score=float_text(F.col("score")), status=F.col("status")
        ),
        state,
        when_any("duplicates", wording.SUMMARY_DUPLICATES, duplicates=F.col("duplicates")),
        when_any("high", wording.SUMMARY_HIGH, count=F.col("high")),
        when_any("medium", wording.SUMMARY_MEDIUM, count=F.col("medium")),
        when_any("low", wording.SUMMARY_LOW, count=F.col("low")),
        F.when(F.col("all_findings") == 0, wording.SUMMARY_CLEAN),
    )
    return facts.select(text.alias("summary"))
