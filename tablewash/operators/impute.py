"""Missing-value imputation (A6-A10) with its plan and checks.

All statistics are computed before any value changes: means in one ``agg``,
medians through :mod:`.quantiles` (exact, bounded memory), modes of all
columns of one type in one counting job (partial aggregation first), so no
single task ever holds all values of a column. Filling is one ``select``
with ``coalesce``; only one scalar per column reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import guarded_cast, type_label
from ..functions.columns import is_numeric, is_text, nan_to_null, qcol, require_columns
from .quantiles import exact_quantiles
from .profile import null_counts

# Strategy names, the ones allowed per column kind, the types
# that default to the mean, and the log message.
STRATEGIES = ("mean", "median", "mode", "custom")
NUMERIC_STRATEGIES = ("mean", "median", "mode", "custom")
OTHER_STRATEGIES = ("mode", "custom")
MEAN_DEFAULT_TYPES = ("DOUBLE", "INTEGER")
IMPUTE_MSG = "Imputed NULLs in '{col}' with {strategy}: {value}."


def allowed_strategies(dtype: T.DataType) -> tuple[str, ...]:
    """Numeric columns take all four strategies, others mode or custom."""
    return NUMERIC_STRATEGIES if is_numeric(dtype) else OTHER_STRATEGIES


def suggest_imputations(df: DataFrame) -> DataFrame:
    """``(column_name, strategy)`` for every column with NULLs: ``mean``
    for DOUBLE/INTEGER columns, ``mode`` otherwise (one scan)."""
    labels = []
    for f in df.schema.fields:
        labels += [F.lit(f.name), F.lit(type_label(f.dataType))]
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, strategy string")
    label = F.element_at(F.create_map(*labels), F.col("column_name"))
    return null_counts(df).select(
        "column_name",
        F.when(label.isin(*MEAN_DEFAULT_TYPES), "mean").otherwise("mode").alias("strategy"))


def _normalise(df: DataFrame, imputations) -> list[tuple[str, str, object]]:
    seen, out = set(), []
    for imp in imputations:
        if isinstance(imp, (tuple, list)):
            col, strategy, value = (list(imp) + [None])[:3]
        else:
            d = imp.asDict() if hasattr(imp, "asDict") else dict(imp)
            col, strategy, value = d.get("column_name"), d.get("strategy"), d.get("value")
        if not col or not strategy or col in seen:      # first entry wins
            continue
        require_columns(df, [col])
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}; allowed: {STRATEGIES}")
        dt = df.schema[col].dataType
        if strategy not in allowed_strategies(dt):
            raise ValueError(f"strategy {strategy!r} needs a numeric column; "
                             f"{col!r} is {type_label(dt)}")
        if strategy == "custom" and value is None:
            continue
        seen.add(col)
        out.append((col, strategy, value))
    return out


def mode_values(df: DataFrame, columns: list[str]) -> dict:
    """A8 for several columns: the most frequent non-NULL value of each; ties
    go to the smallest value. Columns of one type share one job: unpivot to
    ``(column, value)``, count with partial aggregation, keep the top count
    per column and the smallest value at it (hash aggregates plus a
    broadcast of one row per column)."""
    require_columns(df, columns)
    by_type: dict[str, list[str]] = {}
    for c in dict.fromkeys(columns):
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = {}
    for group in by_type.values():
        pairs = F.array(*[F.struct(F.lit(i).alias("k"),
                                   nan_to_null(c, df.schema[c].dataType).alias("v"))
                          for i, c in enumerate(group)])
        counted = (df.select(F.inline(pairs)).where(F.col("v").isNotNull())
                   .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
        top = counted.groupBy("k").agg(F.max("n").alias("top"))
        modes = (counted.join(F.broadcast(top), "k").where(F.col("n") == F.col("top"))
                 .groupBy("k").agg(F.min("v").alias("mode")))
        found = {r["k"]: r["mode"] for r in modes.collect()}
        for i, c in enumerate(group):
            out[c] = found.get(i)
    return out


def mode_value(df: DataFrame, column: str):
    """The most frequent non-NULL value; ties go to the smallest value."""
    return mode_values(df, [column])[column]


def imputation_values(df: DataFrame, imputations, exact: bool = True) -> dict[str, tuple[str, object]]:
    """``{column: (strategy, value)}`` computed from ``df`` before any fill.

    Medians are exact by default (:mod:`.quantiles`); ``exact=False`` takes
    ``percentile_approx`` in the same aggregation as the means."""
    plan = _normalise(df, imputations)
    values: dict[str, tuple[str, object]] = {}
    means = [c for c, s, _ in plan if s == "mean"]
    medians = [c for c, s, _ in plan if s == "median"]
    aggs = [F.avg(nan_to_null(c, df.schema[c].dataType)).alias(f"m{i}")
            for i, c in enumerate(means)]
    if not exact:
        aggs += [F.percentile_approx(nan_to_null(c, df.schema[c].dataType).cast("double"),
                                     0.5, 10_000).alias(f"q{i}") for i, c in enumerate(medians)]
    if aggs:
        row = df.agg(*aggs).first()
        for i, c in enumerate(means):
            values[c] = ("mean", row[f"m{i}"])
        if not exact:
            for i, c in enumerate(medians):
                values[c] = ("median", row[f"q{i}"])
    if medians and exact:
        q = exact_quantiles(df, medians, [0.5])
        for c in medians:
            values[c] = ("median", q[c][0])
    modes = [c for c, s, _ in plan if s == "mode"]
    if modes:
        for c, v in mode_values(df, modes).items():
            values[c] = ("mode", v)
    for c, s, v in plan:
        if s == "custom":
            values[c] = ("custom", v)
    return {c: values[c] for c, _, _ in plan}


def fill_literal(value, dt: T.DataType):
    """The fill value in its column's type; text is converted by the same rules as
    a column of text (:func:`guarded_cast`), a value that doesn't fit is NULL."""
    if isinstance(value, str) and not is_text(dt):
        return guarded_cast(F.lit(value), T.StringType(), dt)
    if isinstance(dt, T.IntegralType) and isinstance(value, float):
        # filling a fractional statistic into an integer rounds half to even
        return F.lit(float(round(value))).cast(dt)
    return F.lit(value).try_cast(dt)


def impute_with_log(df: DataFrame, imputations, exact: bool = True):
    """A10: fill NULLs per column; returns ``(frame, log)``. A column whose
    statistic is NULL (all values missing) is left alone and not logged."""
    return fill_nulls(df, imputation_values(df, imputations, exact))


def fill_nulls(df: DataFrame, values: dict):
    """Fill NULLs from ``{column: (strategy, value)}`` (one ``select``);
    returns ``(frame, log)``. ``None`` values are skipped."""
    fills, log = {}, []
    for c, (strategy, v) in values.items():
        if v is None:
            continue
        fills[c] = fill_literal(v, df.schema[c].dataType)
        log.append(IMPUTE_MSG.format(col=c, strategy=strategy, value=v))
    custom = [c for c in fills if values[c][0] == "custom"]
    if custom:   # a custom value must fit its column: check all in one tiny job
        row = df.sparkSession.range(1).select(
            *[fills[c].isNull().alias(f"b{i}") for i, c in enumerate(custom)]).first()
        bad = [c for i, c in enumerate(custom) if row[f"b{i}"]]
        if bad:
            raise ValueError(f"custom value(s) for {bad} cannot be stored in their column type")
    out = df.select(*[F.coalesce(qcol(f.name), fills[f.name]).alias(f.name)
                      if f.name in fills else qcol(f.name) for f in df.schema.fields])
    return out, log


def impute(df: DataFrame, imputations, exact: bool = True) -> DataFrame:
    """A10 without the log."""
    return impute_with_log(df, imputations, exact)[0]
