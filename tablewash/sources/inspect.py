"""Describe (S10) and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.casts import type_label
from ..functions.columns import finite_or_null


def describe(df: DataFrame) -> DataFrame:
    """S10 as a DataFrame ``(column_name, column_type, nullable)`` (schema only,
    no job)."""
    rows = [(f.name, type_label(f.dataType), "YES" if f.nullable else "NO")
            for f in df.schema.fields]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, column_type string, nullable string")


def describe_rows(df: DataFrame) -> list[dict]:
    """Schema records in the shape of a SQL ``DESCRIBE`` (``key``, ``default``
    and ``extra`` are always empty for a DataFrame)."""
    return [{"column_name": f.name, "column_type": type_label(f.dataType),
             "null": "YES" if f.nullable else "NO", "key": None, "default": None,
             "extra": None} for f in df.schema.fields]


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows with NaN and infinities shown as NULL."""
    return df.limit(n).select(*[finite_or_null(f.name, f.dataType).alias(f.name)
                                for f in df.schema.fields])


def preview_rows(df: DataFrame, n: int = 5) -> list[dict]:
    return [r.asDict(recursive=True) for r in preview(df, n).collect()]
