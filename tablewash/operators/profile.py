"""Profile (A1-A4): row and column counts, NULL counts, exact-duplicate count.

NULL counts and types come from one scan (:func:`null_counts`,
:func:`profile_columns`) without a shuffle of rows. ``profile`` takes the row,
duplicate and NULL counts in one job: rows grouped on all columns (partial
aggregation first), then the counts summed from the groups, since NULL-ness is
part of the grouping key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol, unpivot_row
from ..sources.inspect import describe_rows, preview_rows


def null_counts(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """A2: ``(column_name, null_count)`` from a single scan of all columns.

    With ``only_positive`` (the reference's rule) columns without NULLs are
    left out.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, null_count bigint")
    agg = df.agg(*[F.count_if(qcol(c).isNull()).alias(f"n{i}")
                   for i, c in enumerate(df.columns)])
    out = unpivot_row(agg, "column_name",
                      [(c, F.col(f"n{i}")) for i, c in enumerate(df.columns)],
                      "null_count")
    return out.where(F.col("null_count") > 0) if only_positive else out


def duplicates_count(df: DataFrame) -> int:
    """A3: rows minus distinct rows."""
    return int(duplicates_count_df(df).first()[0]) if df.columns else 0


def duplicates_count_df(df: DataFrame) -> DataFrame:
    """A3 as a one-row DataFrame ``(duplicates_count)``."""
    grouped = df.groupBy(*[qcol(c) for c in df.columns]).count()
    return grouped.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))
                       .cast("bigint").alias("duplicates_count"))


def profile_counts(df: DataFrame) -> DataFrame:
    """A1+A2+A3 in one job: one row ``(total_rows, duplicates_count, n0..nk)``
    where ``n<i>`` is the NULL count of column ``i``."""
    cols = df.columns
    grouped = df.groupBy(*[qcol(c) for c in cols]).count()
    cnt = F.col("count")
    aggs = [F.coalesce(F.sum(cnt), F.lit(0)).cast("bigint").alias("total_rows"),
            F.coalesce(F.sum(cnt - 1), F.lit(0)).cast("bigint").alias("duplicates_count")]
    aggs += [F.coalesce(F.sum(F.when(qcol(c).isNull(), cnt)), F.lit(0)).cast("bigint")
             .alias(f"n{i}") for i, c in enumerate(cols)]
    return grouped.agg(*aggs)


def profile_columns(df: DataFrame) -> DataFrame:
    """Per-column profile rows ``(column_name, column_type, null_count)``."""
    from ..functions.casts import type_label
    labels = F.create_map(*[F.lit(x) for c in df.columns for x in (c, type_label(df.schema[c].dataType))]) \
        if df.columns else F.lit(None)
    return null_counts(df, only_positive=False).select(
        "column_name", F.element_at(labels, F.col("column_name")).alias("column_type"), "null_count") \
        if df.columns else null_counts(df).select("column_name", labels.cast("string").alias("column_type"), "null_count")


@dataclass
class Profile:
    total_rows: int
    total_columns: int
    schema: list[dict]
    null_counts: dict[str, int]
    duplicates_count: int
    sample_preview: list[dict] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"total_rows": self.total_rows, "total_columns": self.total_columns,
                "schema": self.schema, "null_counts": self.null_counts,
                "duplicates_count": self.duplicates_count,
                "sample_preview": self.sample_preview}


def profile(df: DataFrame, preview: int = 5) -> Profile:
    """A4: the full profile: one grouped job, and a ``limit`` for the preview; only
    scalars and ``preview`` rows reach the driver."""
    cols = df.columns
    if cols:
        row = profile_counts(df).first()
        total, dups = int(row["total_rows"]), int(row["duplicates_count"])
        nulls = {c: int(row[f"n{i}"]) for i, c in enumerate(cols) if row[f"n{i}"]}
    else:
        total, dups, nulls = df.count(), 0, {}
    return Profile(total_rows=total, total_columns=len(cols),
                   schema=describe_rows(df), null_counts=nulls,
                   duplicates_count=dups, sample_preview=preview_rows(df, preview))
