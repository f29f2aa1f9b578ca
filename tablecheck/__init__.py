"""How far can a table be trusted? Profiling, checks, score, statistics and advice."""

from tablecheck.operators.metrics import TableMetrics
from tablecheck.plans.report import QualityReport, quality_report
from tablecheck.plans.rules import Limits, Rule

__all__ = ["Limits", "QualityReport", "Rule", "TableMetrics", "quality_report"]
