"""Column references and type tests shared by every operator.

Names are quoted with back-ticks so that columns such as ``a.b`` or ``c d``
resolve as one name rather than as a struct path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qcol(name: str) -> Column:
    """Column for a literal name (no struct-path parsing)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def require_columns(df: DataFrame, names, what: str = "column") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown {what}(s) {missing}; available: {df.columns}")


def finite_or_null(name: str, dt: T.DataType) -> Column:
    """NaN and +/-inf become NULL; other values pass through unchanged."""
    c = qcol(name)
    if is_floating(dt):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    return c


def nan_to_null(name: str, dt: T.DataType) -> Column:
    """NaN becomes NULL (the pandas notion of missing); infinities stay."""
    c = qcol(name)
    if is_floating(dt):
        return F.when(~F.isnan(c), c)
    return c


def unpivot_row(df: DataFrame, key_name: str, entries: list[tuple[str, Column]],
                value_name: str = "value") -> DataFrame:
    """Turn the expressions of a one-row frame into rows ``(key, value)``.

    Used after a single wide ``agg`` so that per-column results stay a
    DataFrame (no collect). ``entries`` is ``[(key, expr over df)]``.
    """
    if not entries:
        raise ValueError("nothing to unpivot")
    arr = F.array(*[F.struct(F.lit(k).alias(key_name), e.alias(value_name))
                    for k, e in entries])
    return df.select(F.inline(arr))
