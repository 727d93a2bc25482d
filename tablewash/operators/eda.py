"""Statistical summary (A14-A17), per-column top values (W2) and the
presentation rules the EDA page applies to them (I5-I8).

Shapes are long (one row per column or per pair) so that a table with
hundreds of columns gives a tall small frame, not a wide plan.

* Numeric summary: count/mean/std/min/max of all numeric columns ride on
  the first scan of :mod:`.quantiles` (exact quartiles); ``exact=False``
  uses ``percentile_approx`` and stays a single lazy aggregation.
* Categorical summary: all text columns are unpivoted to ``(column, value)``
  and counted in **one** shuffle with map-side partial aggregation; the
  top-k per column is a ``row_number`` window that Spark runs as a partial
  ``WindowGroupLimit`` before its exchange, so each task ships at most k
  rows per column.
* Correlation: pairwise-complete Pearson r from co-moment states of column
  tiles, added up by Spark; no rows are shuffled, and a constant column is
  left out instead of failing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (is_numeric, is_text, nan_to_null, qcol,
                                 require_columns, unpivot_row)
from .quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)
TOP_BUCKETS = 64  # per column, when its most frequent values are ranked

NUMERIC_SCHEMA = ("column string, count bigint, mean double, std double, min double, "
                  "p25 double, p50 double, p75 double, max double")


def _numeric(df: DataFrame, columns=None) -> list[str]:
    if columns is not None:
        require_columns(df, columns)
        return list(columns)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def _categorical(df: DataFrame, columns=None) -> list[str]:
    base = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if columns is None:
        return base
    require_columns(df, columns)
    return base + [c for c in columns if c not in base]


def _finite(v):
    return None if v is None or (isinstance(v, float) and not (v == v and abs(v) != float("inf"))) else v


def numeric_summary(df: DataFrame, columns: list[str] | None = None,
                    exact: bool = True) -> DataFrame:
    """``(column, count, mean, std, min, p25, p50, p75, max)`` per numeric
    column. NaN is missing; non-finite results are NULL; ``std`` is the sample
    standard deviation (NULL for a single value).

    ``exact=True`` runs the exact quartile search of :mod:`.quantiles`, whose
    first scan also computes the other statistics; the result is a small
    frame of one row per column. ``exact=False`` is one lazy aggregation with
    ``percentile_approx`` quartiles.
    """
    return _numeric_summary(df, columns, exact)[0]


def numeric_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, count, mean, std)`` per numeric column, NaN as missing, from one
    aggregation without quantiles."""
    cols = _numeric(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count bigint, mean double, std double")
    xs = [nan_to_null(c, df.schema[c].dataType).cast("double") for c in cols]
    one = df.agg(*[F.struct(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
                   .alias(f"s{i}") for i, x in enumerate(xs)])
    long = unpivot_row(one, "column", [(c, F.col(f"s{i}")) for i, c in enumerate(cols)], "s").select("column", "s.*")
    finite = lambda c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return long.select("column", "count", finite("mean").alias("mean"), finite("std").alias("std"))


def _numeric_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = True):
    """``(summary frame, total rows or None)``; the exact form counts all rows
    in its first scan as well."""
    cols = _numeric(df, columns)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], NUMERIC_SCHEMA), None
    xs = {c: nan_to_null(c, df.schema[c].dataType).cast("double") for c in cols}

    def basic(x):
        return [F.count(x).alias("count"), F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]

    if exact:
        extra = [F.struct(*basic(xs[c])).alias(f"s{i}") for i, c in enumerate(cols)]
        extra.append(F.count(F.lit(1)).alias("__rows"))
        qs, row = exact_quantiles(df, cols, list(QUARTILES), extra_aggs=extra)
        rows = []
        for i, c in enumerate(cols):
            s = row[f"s{i}"]
            q = qs[c]
            rows.append((c, int(s["count"]), _finite(s["mean"]), _finite(s["std"]),
                         _finite(s["min"]), _finite(q[0]), _finite(q[1]), _finite(q[2]),
                         _finite(s["max"])))
        return spark.createDataFrame(rows, NUMERIC_SCHEMA), int(row["__rows"])

    stats = []
    for i, c in enumerate(cols):
        q = F.percentile_approx(xs[c], list(QUARTILES), 10_000)
        fields = basic(xs[c]) + [q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75")]
        stats.append(F.struct(*fields).alias(f"s{i}"))
    one = df.agg(*stats)
    long = unpivot_row(one, "column", [(c, F.col(f"s{i}")) for i, c in enumerate(cols)], "s")
    long = long.select("column", "s.count", "s.mean", "s.std", "s.min",
                       "s.p25", "s.p50", "s.p75", "s.max")
    fin = lambda c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return long.select("column", F.col("count").cast("bigint"),
                       *[fin(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]), None


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, count)`` for every non-NULL value of every text column,
    counted in one shuffle after map-side partial aggregation."""
    cols = _categorical(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value"))
                      for c in cols])
    long = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None,
               counts: DataFrame | None = None) -> DataFrame:
    """``(column, rank, value, count)``, the ``k`` most frequent values per
    column; ties broken by value ascending. Values are ranked within
    ``TOP_BUCKETS`` buckets per column first, so no task ranks all of a column."""
    vc = counts if counts is not None else value_counts(df, columns)
    order = [F.col("count").desc(), F.col("value").asc()]
    bucket = F.pmod(F.xxhash64("value"), F.lit(TOP_BUCKETS))
    part = Window.partitionBy("column", "__b").orderBy(*order)
    best = vc.withColumn("__b", bucket).withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= k)
    w = Window.partitionBy("column").orderBy(*order)
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", F.col("rank").cast("int"), "value", "count"))


def categorical_summary(df: DataFrame, columns: list[str] | None = None,
                        approx: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """``(column, unique_count, mode, mode_count)`` per text column.

    One shuffle of ``(column, value)`` counts (planned once, reused), then
    per column the distinct-value count and the top count, and the mode as
    the smallest value at the top count (a sort-based aggregate, of the few values
    at that count only). Every step aggregates partially, so each task sends a few
    rows per column. ``counts`` takes value counts made before.
    ``approx=True`` counts distinct values with HyperLogLog++ (the mode is
    still exact).
    """
    cols = _categorical(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, unique_count bigint, mode string, mode_count bigint")
    vc = value_counts(df, cols) if counts is None else counts
    # hash aggregations only: count and top count per column, then the
    # values tied at the top count (a broadcast of one row per column, a
    # bound fixed by the schema) and the smallest of those
    per = vc.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"),
                                   F.max("count").alias("mode_count"))
    tops = (vc.join(F.broadcast(per.select("column", "mode_count")), "column")
            .where(F.col("count") == F.col("mode_count"))
            .groupBy("column").agg(F.min("value").alias("mode")))
    per = per.join(tops, "column", "left")
    if approx:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value"))
                          for c in cols])
        hll = (df.select(F.inline(pairs)).groupBy("column")
               .agg(F.approx_count_distinct("value").alias("approx_unique")))
        per = per.join(hll, "column", "left").withColumn("unique_count", F.col("approx_unique"))
    # every requested column is listed, also one without any value
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(per, "column", "left")
            .select("column", F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
                    "mode", F.col("mode_count").cast("bigint")))


TILE = 64  # columns; a task sends one state for each pair of tiles
STATE_BUCKETS = 256
CELLS = 1 << 20  # values that a task looks at together


def _comoments(frame: DataFrame, means: list[float]) -> DataFrame:
    """``ti, tj, v``: the summed state of every pair of tiles of columns. Columns ``x0``,
    ``x1`` and so on hold doubles, NULL or NaN where missing.

    With ``M`` = present and ``D`` = value less the column's mean (0 where missing), a
    state holds, over the rows where both values of a pair exist: their number
    ``M'M``, the sums ``D'M`` and ``M'D``, the sums of squares ``(D*D)'M`` and
    ``M'(D*D)``, and the products ``D'D``. States add up. Spark adds them in two levels,
    so that no task takes one state from every input split.
    """
    k, tile, cells = len(means), TILE, CELLS

    def states(batches):
        import numpy as np
        import pyarrow as pa

        mu, acc = np.array(means), {}
        step = max(1, cells // k)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                d = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns], axis=1) - mu
                m = ~np.isnan(d)
                d[~m] = 0.0
                m, dd = m.astype(float), d * d
                for i in range(0, k, tile):
                    x = slice(i, i + tile)
                    for j in range(i, k, tile):
                        y = slice(j, j + tile)
                        v = np.stack([m[:, x].T @ m[:, y], d[:, x].T @ m[:, y], m[:, x].T @ d[:, y],
                                      dd[:, x].T @ m[:, y], m[:, x].T @ dd[:, y], d[:, x].T @ d[:, y]])
                        acc[i, j] = v if (i, j) not in acc else acc[i, j] + v
        for (i, j), v in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([v.ravel()])],
                                             names=["ti", "tj", "v"])

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    bucket = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(STATE_BUCKETS)).alias("b")
    per_task = frame.mapInArrow(states, "ti int, tj int, v array<double>").select("ti", "tj", bucket, array_to_vector("v").alias("v"))
    some = per_task.groupBy("ti", "tj", "b").agg(Summarizer.sum(F.col("v")).alias("v"))
    return some.groupBy("ti", "tj").agg(Summarizer.sum(F.col("v")).alias("v"))


def _pearson(states: DataFrame, k: int) -> DataFrame:
    """``i, j, r`` of the pairs i < j with a defined correlation."""
    tile = TILE

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for ti, tj, v in zip(*(c.to_pylist() for c in b.columns)):
                wide, high = min(tile, k - ti), min(tile, k - tj)
                n, sa, sb, saa, sbb, sab = np.array(v).reshape(6, wide, high)
                with np.errstate(all="ignore"):
                    cov = sab / n - (sa / n) * (sb / n)
                    va, vb = saa / n - (sa / n) ** 2, sbb / n - (sb / n) ** 2
                    r = cov / np.sqrt(va * vb)
                    # a variance this small is what rounding leaves of a constant
                    fine = (n >= 2) & (va > 1e-13 * saa / n) & (vb > 1e-13 * sbb / n) & np.isfinite(r)
                i, j = np.nonzero(fine & (np.arange(wide)[:, None] + ti < np.arange(high)[None, :] + tj))
                yield pa.RecordBatch.from_arrays([pa.array(i + ti, pa.int32()), pa.array(j + tj, pa.int32()),
                                                  pa.array(np.clip(r[i, j], -1.0, 1.0))], names=["i", "j", "r"])

    from pyspark.ml.functions import vector_to_array

    return states.select("ti", "tj", vector_to_array("v").alias("v")).mapInArrow(run, "i int, j int, r double")


def correlation_pairs(df: DataFrame, columns: list[str] | None = None,
                      digits: int = 4) -> DataFrame:
    """``(col1, col2, correlation)`` for the upper triangle in column
    order, over pairwise-complete rows, rounded; undefined pairs (a constant
    side, fewer than two rows) are left out.

    One plan for every table, with or without NULLs, narrow or wide: an ``agg`` for
    count, mean, minimum and maximum of every column (constant columns end there), then
    one pass of pairwise-complete co-moment states (:func:`_comoments`), a matrix
    product per pair of tiles and batch. No rows are shuffled, only states, whose size is
    that of the tiles. The result, one row per pair, is made once and is small.
    """
    cols = _numeric(df, columns)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "col1 string, col2 string, correlation double")
    xs = {c: nan_to_null(c, df.schema[c].dataType).cast("double") for c in cols}
    first = df.agg(*[F.struct(F.count(xs[c]).alias("n"), F.avg(xs[c]).alias("m"),
                              F.min(xs[c]).alias("lo"), F.max(xs[c]).alias("hi")).alias(f"c{i}")
                     for i, c in enumerate(cols)]).first()
    info = {c: first[f"c{i}"] for i, c in enumerate(cols)}
    live = [c for c in cols if info[c]["n"] >= 2 and info[c]["lo"] != info[c]["hi"]
            and _finite(info[c]["m"]) is not None]
    out = []
    if len(live) > 1:
        states = _comoments(df.select(*[xs[c].alias(f"x{i}") for i, c in enumerate(live)]), [info[c]["m"] for c in live])
        out = [(live[i], live[j], r) for i, j, r in sorted(tuple(x) for x in _pearson(states, len(live)).collect())]
    return (spark.createDataFrame(out, "col1 string, col2 string, r double")
            .select("col1", "col2", F.round("r", digits).alias("correlation")))


# Heat-map bands (strictly greater than each bound).
BANDS = ((0.8, "very_strong"), (0.5, "strong"), (0.2, "moderate"))
WEAK = "weak"


def correlation_band(r) -> "F.Column":
    """Band label of ``|r|``."""
    a = F.abs(r if not isinstance(r, str) else F.col(r))
    expr = F.when(a > BANDS[0][0], BANDS[0][1])
    for bound, label in BANDS[1:]:
        expr = expr.when(a > bound, label)
    return expr.otherwise(WEAK)


def correlation_long(pairs: DataFrame) -> DataFrame:
    """I5 (long form): ``(row_col, col_col, correlation, band)`` mirrored,
    with 1.0 on the diagonal, for every column that appears in a pair."""
    fwd = pairs.select(F.col("col1").alias("row_col"), F.col("col2").alias("col_col"), "correlation")
    back = pairs.select(F.col("col2").alias("row_col"), F.col("col1").alias("col_col"), "correlation")
    names = fwd.select("row_col").union(back.select("row_col")).distinct()
    diag = names.select("row_col", F.col("row_col").alias("col_col"), F.lit(1.0).alias("correlation"))
    full = fwd.unionByName(back).unionByName(diag)
    return full.withColumn("band", correlation_band("correlation"))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Square matrix ``(column, <c1>, <c2>, ...)``; a missing pair is NULL."""
    long = correlation_long(pairs)
    names = sorted(r[0] for r in long.select("row_col").distinct().collect())
    return (long.groupBy(F.col("row_col").alias("column")).pivot("col_col", names)
            .agg(F.first("correlation")).orderBy("column"))


def numeric_table(summary: DataFrame, digits: int = 2) -> DataFrame:
    """Mean and std as text with ``digits`` decimals, NULL shown as N/A."""
    def fmt(c):
        # format_string renders a NULL argument as text ('nu' at %.2f), so
        # test for NULL explicitly
        return (F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.round(F.col(c), digits)))
                .otherwise(F.lit("N/A")))
    return summary.select("column", "count", fmt("mean").alias("mean_text"),
                          fmt("std").alias("std_text"))


def top_values_text(top: DataFrame) -> DataFrame:
    """I8: ``(column, top_values)`` as ``v (n); v (n)`` in rank order."""
    item = F.struct("rank", F.format_string("%s (%d)", F.col("value"), F.col("count")).alias("t"))
    return (top.groupBy("column").agg(F.sort_array(F.collect_list(item)).alias("items"))
            .select("column", F.array_join(F.transform("items", lambda s: s["t"]), "; ")
                    .alias("top_values")))


# Key names of the summary dictionary.
NUMERIC_KEYS = (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max"))


@dataclass
class StatisticalSummary:
    numeric_summary: DataFrame
    categorical_summary: DataFrame
    top_values: DataFrame
    correlation_pairs: DataFrame
    total_rows: int
    total_columns: int

    def to_dict(self) -> dict:
        """The summary as nested dictionaries (numeric statistics keyed
        ``count, mean, std, min, 25%, 50%, 75%, max``; per text column
        ``unique_count, mode, top_5_frequencies``; the correlation list).
        Collects only the small per-column frames."""
        numeric = {r["column"]: {key: r[col] for col, key in NUMERIC_KEYS}
                   for r in self.numeric_summary.collect()}
        tops: dict[str, dict] = {}
        for r in self.top_values.orderBy("column", "rank").collect():
            tops.setdefault(r["column"], {})[r["value"]] = r["count"]
        categorical = {r["column"]: {"unique_count": r["unique_count"], "mode": r["mode"],
                                     "top_5_frequencies": tops.get(r["column"], {})}
                       for r in self.categorical_summary.collect()}
        pairs = [{"col1": r["col1"], "col2": r["col2"], "correlation": r["correlation"]}
                 for r in self.correlation_pairs.collect()]
        return {"numeric_summary": numeric, "categorical_summary": categorical,
                "correlation_matrix": pairs, "total_rows": self.total_rows,
                "total_columns": self.total_columns}


def statistical_summary(df: DataFrame, k: int = 5, exact: bool = True) -> StatisticalSummary:
    """The three summaries plus row and column counts.

    The frames are lazy except the numeric one (its exact quartiles need
    counts first). The value counts are planned once for both frames that need
    them.
    """
    counts = value_counts(df)
    numeric, total = _numeric_summary(df, exact=exact)
    return StatisticalSummary(
        numeric_summary=numeric,
        categorical_summary=categorical_summary(df, counts=counts),
        top_values=top_values(df, k, counts=counts),
        correlation_pairs=correlation_pairs(df),
        total_rows=df.count() if total is None else total,
        total_columns=len(df.columns),
    )


def summary_rows(summary: StatisticalSummary) -> DataFrame:
    """A17 as one long frame ``(part, column, name, text, number)``: ``numeric`` rows by
    statistic, ``categorical`` rows (``unique_count``, ``mode``, ``mode_count``), ``top_values``
    by rank, ``correlation`` rows by the second column, and the two totals of the ``table``."""
    text, number, none = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")
    numeric = summary.numeric_summary.select("column", F.inline(F.array(*[
        F.struct(F.lit(key).alias("name"), F.col(col).cast("double").alias("number")) for col, key in NUMERIC_KEYS]))).select(
        F.lit("numeric").alias("part"), "column", "name", text.alias("text"), "number")
    c = summary.categorical_summary
    categorical = c.select(F.lit("categorical").alias("part"), "column", F.inline(F.array(
        F.struct(F.lit("unique_count").alias("name"), text.alias("text"), F.col("unique_count").cast("double").alias("number")),
        F.struct(F.lit("mode").alias("name"), F.col("mode").alias("text"), number.alias("number")),
        F.struct(F.lit("mode_count").alias("name"), text.alias("text"), F.col("mode_count").cast("double").alias("number")))))
    top = summary.top_values.select(F.lit("top_values").alias("part"), "column", F.col("rank").cast("string").alias("name"),
                                    F.col("value").alias("text"), F.col("count").cast("double").alias("number"))
    pairs = summary.correlation_pairs.select(F.lit("correlation").alias("part"), F.col("col1").alias("column"),
                                             F.col("col2").alias("name"), text.alias("text"), F.col("correlation").alias("number"))
    table = summary.numeric_summary.sparkSession.range(1).select(F.lit("table").alias("part"), none.alias("column"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), text.alias("text"), F.lit(v).cast("double").alias("number"))
        for n, v in (("total_rows", summary.total_rows), ("total_columns", summary.total_columns))])))
    return numeric.union(categorical).union(top).union(pairs).union(table)
