"""The sentences of findings, insights and the summary.

``{name}`` marks a value filled in per finding. The text is part of the result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# issue -> (business impact, recommendation)
MISSING_HIGH = (
    "Column '{column}' has {missing_pct}% missing values — more than half the data is absent. "
    "Any analysis using this column will be unreliable.",
    "Consider dropping column '{column}' if missing rate exceeds 70%. "
    "If the column is critical, investigate the data pipeline for ingestion failures upstream.",
)
MISSING_MEDIUM_IMPACT = (
    "Column '{column}' has {missing_pct}% missing values. "
    "This will introduce bias in any analysis or model using this column."
)
MISSING_MEDIUM_NUMERIC = (
    "Impute missing values in '{column}' using median (robust to outliers) or mean imputation. "
    "For time series data, consider forward-fill."
)
MISSING_MEDIUM_OTHER = (
    "Impute missing values in '{column}' using mode (most frequent value) "
    "or add an explicit 'Unknown' category."
)
MISSING_LOW = (
    "Column '{column}' has {missing_pct}% missing values — "
    "low but worth addressing before production use.",
    "Safe to impute '{column}' with {average}. Impact on analysis will be minimal.",
)
OUTLIERS = (
    "{outlier_count} outliers ({outlier_pct}%) detected in '{column}'. "
    "Mean={mean}, Median={median}. "
    "Outliers can skew averages, corrupt ML model training and lead to misleading business insights.",
    "Investigate outliers in '{column}' — are they data entry errors or genuine values? "
    "If errors: cap using IQR method. "
    "If genuine: use median instead of mean for reporting, and consider robust scaling for ML.",
)
CONSTANT = (
    "Column '{column}' has only one unique value and adds no analytical value.",
    "Consider dropping column '{column}' from your dataset. "
    "Constant columns waste storage and can confuse ML models.",
)
CARDINALITY = (
    "Column '{column}' has nearly unique values in every row — "
    "likely a free-text or ID field that cannot be aggregated.",
    "If '{column}' is an identifier, exclude it from analysis. "
    "If it's free text, consider NLP techniques or bucketing.",
)
ZEROS = (
    "{zero_pct}% of values in '{column}' are zero. "
    "This may indicate missing data encoded as zero, which would skew averages and aggregations.",
    "Verify whether zeros in '{column}' represent actual zero values or missing data. "
    "If missing, replace with NaN and impute.",
)
DUPLICATES = (
    "{duplicate_rows} duplicate rows ({duplicate_pct}%) detected. "
    "Duplicates cause double counting in reports, inflate metrics and corrupt aggregations.",
    "Remove duplicate rows using pandas df.drop_duplicates(). "
    "Investigate the root cause — duplicates often indicate pipeline or ingestion bugs upstream.",
)
ERROR_RATE = (
    "Server error rate is {error_rate_pct}%. "
    "This indicates system instability that may affect data completeness and reliability.",
    "Investigate server logs for 500/502/503 patterns. "
    "High error rates often indicate infrastructure issues or upstream service failures.",
)

SUMMARY_STATE = {
    "PASS": "Your dataset is in excellent condition and ready for analysis.",
    "WARNING": "Your dataset has some quality issues that should be addressed before analysis.",
    "other": "Your dataset has critical quality issues. "
    "Analysis based on this data may be unreliable.",
}
SUMMARY_SIZE = "Dataset contains {rows} rows and {columns} columns."
SUMMARY_SCORE = "Overall Data Quality Score: {score}/100 — {status}."
SUMMARY_DUPLICATES = "Found {duplicates} duplicate rows that should be removed."
SUMMARY_HIGH = "{count} critical issue(s) require immediate attention."
SUMMARY_MEDIUM = "{count} moderate issue(s) should be reviewed."
SUMMARY_LOW = "{count} minor issue(s) flagged for awareness."
SUMMARY_CLEAN = "No issues detected — data meets all quality standards."

INSIGHT_MISSING = "'{column}' has the highest missing rate ({pct}%)."
INSIGHT_CORRELATION = (
    "Strong {sign} correlation ({r}) between '{a}' and '{b}'. "
    "These features may be redundant in ML models."
)
INSIGHT_SKEW = (
    "'{column}' is heavily {side}-skewed (skewness={skewness}). "
    "Consider log transformation before analysis."
)
INSIGHT_VARIANCE = (
    "'{column}' has very low variance (CV={cv}). "
    "This column may not be useful for predictive modelling."
)


def sentence(template: str, **values: Column) -> Column:
    """A template as one string expression."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            parts.append(values[piece[1:-1]].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


