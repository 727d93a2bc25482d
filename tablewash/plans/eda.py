"""The EDA page as one call: summary, insights, chart suggestions.

The summary is computed once and handed to the insight and suggestion
rules (the reference computes it twice and pulls the table twice).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.charts import suggest_charts
from ..operators.eda import StatisticalSummary, statistical_summary
from ..operators.insights import detect_insights


@dataclass
class EdaReport:
    summary: StatisticalSummary
    insights: DataFrame
    chart_suggestions: DataFrame


def eda_report(df: DataFrame, k: int = 5, exact: bool = True) -> EdaReport:
    s = statistical_summary(df, k=k, exact=exact)
    return EdaReport(s, detect_insights(df, s), suggest_charts(df, s))
