"""The whole report on one table, as frames, as one nested row, or as JSON."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.operators.metrics import PROFILE_CHAINS, RULE_CHAINS, TableMetrics
from tablecheck.operators.table import side_by_side
from tablecheck.plans import eda, profile, recommend, rules, schema
from tablecheck.session import settled, small_frame


ONE_ROW_SECTIONS = (
    "quality_score", "table", "summary", "time_span", "parse_report", "source",
)


class QualityReport:
    """Sections are computed on first use; passes over the data are shared."""

    def __init__(
        self,
        df: DataFrame,
        limits: rules.Limits = rules.Limits(),
        custom_rules: list[rules.Rule] | None = None,
        semantic_overrides: dict[str, str] | None = None,
        order_by: str | None = None,
        source: dict[str, str] | None = None,
        parse_report: DataFrame | None = None,
        **metric_options,
    ):
        self.metrics = TableMetrics(df, **metric_options)
        self.limits = limits
        self.custom_rules = custom_rules
        self.semantic_overrides = semantic_overrides
        self.order_by = order_by
        self.source = source
        self.parse_report = parse_report

    @cached_property
    def column_profile(self) -> DataFrame:
        return profile.column_profile(self.metrics.prefetch(PROFILE_CHAINS))

    @cached_property
    def _rule_facts(self) -> DataFrame:
        """Custom rules may ask for any metric, generated ones need few."""
        if self.custom_rules or "column_profile" in self.__dict__:
            return self.column_profile
        return profile.column_basics(self.metrics.prefetch(RULE_CHAINS))

    @cached_property
    def table_profile(self) -> DataFrame:
        return profile.table_profile(self.metrics)

    @cached_property
    def column_schema(self) -> DataFrame:
        return schema.column_schema(self.metrics, self.semantic_overrides, self.order_by)

    @cached_property
    def _meaning(self) -> DataFrame:
        """Only what rules and advice need, without sample values."""
        rows = [
            {"column": c.name,
             "semantic_type": schema.semantic_type(c, self.semantic_overrides)}
            for c in self.metrics.columns
        ]
        return small_frame(
            self.metrics.spark, rows, "column string, semantic_type string"
        )

    @cached_property
    def rules(self) -> DataFrame:
        return settled(
            rules.generate_rules(
                self._rule_facts, self._meaning, self.table_profile, self.limits
            )
        )

    @cached_property
    def rule_results(self) -> DataFrame:
        return settled(
            rules.evaluate_rules(
                self.rules, self._rule_facts, self.table_profile, self.custom_rules
            )
        )

    @cached_property
    def score(self) -> DataFrame:
        return settled(rules.score(self.rule_results))

    @cached_property
    def failed_rules(self) -> DataFrame:
        return rules.failed_rules(self.rule_results)

    @cached_property
    def column_issues(self) -> DataFrame:
        return rules.column_issues(self._rule_facts)

    @cached_property
    def recommendations(self) -> DataFrame:
        return settled(
            recommend.recommendations(
                self.column_profile, self._meaning, self.table_profile
            )
        )

    @cached_property
    def summary(self) -> DataFrame:
        return settled(
            recommend.summary(self.table_profile, self.score, self.recommendations)
        )

    @cached_property
    def status_distribution(self) -> DataFrame:
        return profile.status_distribution(self.metrics)

    @cached_property
    def numeric_summary(self) -> DataFrame:
        return eda.numeric_summary(self.metrics)

    @cached_property
    def correlation_matrix(self) -> DataFrame:
        return eda.correlation_matrix(self.metrics)

    @cached_property
    def strong_correlations(self) -> DataFrame:
        return eda.strong_correlations(self.metrics)

    @cached_property
    def histograms(self) -> DataFrame:
        return eda.histograms(self.metrics)

    @cached_property
    def distribution_shapes(self) -> DataFrame:
        return eda.distribution_shapes(self.metrics)

    @cached_property
    def categorical_summary(self) -> DataFrame:
        return eda.categorical_summary(self.metrics)

    @cached_property
    def top_values(self) -> DataFrame:
        return eda.top_values(self.metrics)

    @cached_property
    def outlier_analysis(self) -> DataFrame:
        return eda.outlier_analysis(self.metrics, self.order_by)

    @cached_property
    def missing_columns(self) -> DataFrame:
        return eda.missing_columns(self.metrics)

    @cached_property
    def co_missing_pairs(self) -> DataFrame:
        return eda.co_missing_pairs(self.metrics)

    @cached_property
    def insights(self) -> DataFrame:
        return eda.insights(self.metrics)

    def prefetch(self) -> "QualityReport":
        """Compute everything, independent parts at the same time."""
        self.metrics.prefetch()
        self.column_profile, self.table_profile, self._meaning, self._rule_facts
        side_by_side(
            [
                lambda: self.score,
                lambda: self.recommendations,
                lambda: self.column_schema,
                lambda: self.outlier_analysis,
                lambda: self._log_sections,
            ]
        )
        self.summary
        return self

    @cached_property
    def _log_sections(self) -> dict[str, DataFrame]:
        m, found = self.metrics, {}
        if m.column("status") is not None:
            found["status_distribution"] = profile.status_distribution(m)
        for name in ("ip", "endpoint"):
            if m.column(name) is not None:
                found[f"top_{name}s"] = settled(profile.top_log_values(m, name))
        if m.column("timestamp") is not None:
            found["time_span"] = settled(profile.time_span(m))
        return found

    # ------------------------------------------------------------ one row

    def sections(self) -> dict[str, DataFrame]:
        """Every section by name. All of them are metric frames, none holds data rows."""
        m = self.prefetch().metrics
        found = {
            "quality_score": self.score,
            "table": self.table_profile,
            "summary": self.summary,
            "rule_results": self.rule_results,
            "failed_rules": self.failed_rules,
            "column_issues": self.column_issues,
            "column_profile": self.column_profile,
            "column_schema": self.column_schema,
            "recommendations": self.recommendations,
            "numeric_summary": self.numeric_summary,
            "correlation_matrix": self.correlation_matrix,
            "strong_correlations": self.strong_correlations,
            "histograms": self.histograms,
            "distribution_shapes": self.distribution_shapes,
            "categorical_summary": self.categorical_summary,
            "top_values": self.top_values,
            "outlier_analysis": self.outlier_analysis,
            "missing_columns": self.missing_columns,
            "co_missing_pairs": self.co_missing_pairs,
            "insights": self.insights,
        }
        found.update(self._log_sections)
        if self.parse_report is not None:
            found["parse_report"] = self.parse_report
        if self.source:
            schema_text = ", ".join(f"{k} string" for k in self.source)
            found["source"] = small_frame(m.spark, [self.source], schema_text)
        return found

    def as_frame(self) -> DataFrame:
        """The report as one row: a struct per one-row section, an array per list."""
        return self._one_row

    @cached_property
    def _one_row(self) -> DataFrame:
        row, fields = {}, []
        sections = self.sections()
        rows: dict = {}

        def collect(name):
            rows[name] = [r.asDict(recursive=True) for r in sections[name].collect()]

        side_by_side([lambda n=n: collect(n) for n in sections])
        for name, frame in sections.items():
            items = rows[name]
            if name in ONE_ROW_SECTIONS:
                row[name] = items[0] if items else None
                fields.append(T.StructField(name, frame.schema))
            else:
                row[name] = items
                fields.append(T.StructField(name, T.ArrayType(frame.schema)))
        return small_frame(self.metrics.spark, [row], T.StructType(fields))

    def as_json(self) -> DataFrame:
        """One row with the report as JSON text."""
        frame = self.as_frame()
        return frame.select(
            F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("report")
        )

    def write_json(self, path: str) -> None:
        self.as_frame().write.mode("errorifexists").json(path)


def quality_report(df: DataFrame, **options) -> QualityReport:
    """Profile, judge and explore any DataFrame. See :class:`QualityReport`."""
    return QualityReport(df, **options)
