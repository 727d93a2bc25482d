"""Automatic insights (I1-I4): high correlation, outliers, imbalance.

They read an existing :class:`~.eda.StatisticalSummary` (computed once, not
twice). Outlier counts for all numeric columns are one ``agg`` over the data.
The report is a small DataFrame ``(type, severity, title, description,
affected_columns, seq)`` ordered correlation, outlier, distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, unpivot_row
from .eda import StatisticalSummary, statistical_summary

# Thresholds of the three rules.
HIGH_CORRELATION = 0.8          # |rounded r| >= this
IQR_FACTOR = 1.5
OUTLIER_SHARE = 0.01            # count > this share of all rows ...
OUTLIER_MIN = 5                 # ... and count > this
IMBALANCE_SHARE = 0.9           # mode count / all rows > this

# Insight kinds, severities, titles and message formats.
CORR = ("correlation", "warning", "High Feature Correlation",
        "Columns '%s' and '%s' are highly correlated (%s). Consider removing one for modeling.")
OUTLIER = ("outlier", "warning", "Potential Outliers Detected",
           "Column '%s' has %d values outside the typical 1.5*IQR range. Review with a Box Plot.")
SKEW = ("distribution", "info", "Highly Imbalanced Feature",
        "Categorical column '%s' is highly skewed, with the mode value ('%s') making up %d%% "
        "of the data. This might impact model performance.")

SCHEMA = ("type string, severity string, title string, description string, "
          "affected_columns array<string>, seq bigint")


def _shape(df: DataFrame, kind, description, affected, seq) -> DataFrame:
    return df.select(F.lit(kind[0]).alias("type"), F.lit(kind[1]).alias("severity"),
                     F.lit(kind[2]).alias("title"), description.alias("description"),
                     affected.alias("affected_columns"), seq.cast("bigint").alias("seq"))


def correlation_insights(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with ``|r| >= 0.8`` (r already rounded)."""
    pos = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    hot = pairs.where(F.abs("correlation") >= HIGH_CORRELATION)
    seq = F.element_at(pos, F.col("col1")) * 100_000 + F.element_at(pos, F.col("col2"))
    return _shape(hot, CORR,
                  F.format_string(CORR[3], "col1", "col2", F.col("correlation").cast("string")),
                  F.array("col1", "col2"), F.lit(1_000_000_000_000) + seq)


def outlier_counts(df: DataFrame, numeric: DataFrame) -> DataFrame:
    """``(column, outlier_count)`` outside ``[Q1 - 1.5 IQR, Q3 + 1.5 IQR]`` for
    every numeric column with quartiles, in one aggregation over ``df``."""
    bounds = [(r["column"], r["p25"], r["p75"]) for r in
              numeric.where(F.col("p25").isNotNull() & F.col("p75").isNotNull() & (F.col("count") > 0))
              .select("column", "p25", "p75").collect()]
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, outlier_count bigint")
    aggs = []
    for i, (c, q1, q3) in enumerate(bounds):
        iqr = q3 - q1
        lo, hi = q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr
        x = nan_to_null(c, df.schema[c].dataType)
        aggs.append(F.count_if(x.isNotNull() & ((x < F.lit(lo)) | (x > F.lit(hi)))).alias(f"o{i}"))
    one = df.agg(*aggs)
    return unpivot_row(one, "column", [(c, F.col(f"o{i}")) for i, (c, _, _) in enumerate(bounds)],
                       "outlier_count")


def outlier_insights(df: DataFrame, numeric: DataFrame, total_rows: int) -> DataFrame:
    """Both ``count > 1% of all rows`` and ``count > 5``."""
    cols = df.columns
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    oc = outlier_counts(df, numeric)
    hot = oc.where((F.col("outlier_count") > F.lit(OUTLIER_SHARE * total_rows)) &
                   (F.col("outlier_count") > OUTLIER_MIN))
    return _shape(hot, OUTLIER, F.format_string(OUTLIER[3], "column", "outlier_count"),
                  F.array("column"), F.lit(2_000_000_000_000) + F.element_at(pos, F.col("column")))


def imbalance_insights(top: DataFrame, total_rows: int, columns: list[str]) -> DataFrame:
    """The most frequent value covers more than 90% of **all** rows."""
    pos = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    if total_rows == 0:
        return top.sparkSession.createDataFrame([], SCHEMA)
    share = F.col("count") / F.lit(total_rows)
    hot = top.where((F.col("rank") == 1) & (share > IMBALANCE_SHARE))
    pct = F.bround(share * 100, 0).cast("int")
    return _shape(hot, SKEW, F.format_string(SKEW[3], "column", "value", pct),
                  F.array("column"), F.lit(3_000_000_000_000) + F.element_at(pos, F.col("column")))


def detect_insights(df: DataFrame, summary: StatisticalSummary | None = None) -> DataFrame:
    """I4: I1, I2 and I3 in that order (``seq`` ascending)."""
    s = summary or statistical_summary(df)
    numeric_cols = [r[0] for r in s.numeric_summary.select("column").collect()]
    parts = [correlation_insights(s.correlation_pairs, numeric_cols),
             outlier_insights(df, s.numeric_summary, s.total_rows),
             imbalance_insights(s.top_values, s.total_rows, df.columns)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.orderBy("seq")


def insights_list(insights: DataFrame) -> list[dict]:
    """The (small) insight report as a list of dictionaries, in order."""
    return [{"type": r["type"], "severity": r["severity"], "title": r["title"],
             "description": r["description"], "affected_columns": list(r["affected_columns"])}
            for r in insights.orderBy("seq").collect()]
