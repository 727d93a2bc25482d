"""Type suggestion (A5), conversion (P6), conversion report (P7) and the
default conversion plan (I11).

Each is one pass: all text columns are tested in one ``agg``; all
conversions are applied in one ``select`` that keeps column positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import guarded_cast, parse_type, text_to_double, type_label
from ..functions.columns import is_text, qcol, unpivot_row

# The suggestion rule (strictly above this share of non-empty
# values must parse as DOUBLE) and the labels it reports.
SUGGEST_THRESHOLD = 0.95
SUGGEST_FROM = "VARCHAR"
SUGGEST_TO = "DOUBLE"


def suggest_types(df: DataFrame, threshold: float = SUGGEST_THRESHOLD) -> DataFrame:
    """A5: ``(column_name, current_type, suggested_type, confidence)`` for text
    columns whose non-empty values parse as numbers in more than ``threshold``
    of cases; confidence is rounded to 2 places."""
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    schema = "column_name string, current_type string, suggested_type string, confidence double"
    if not texts:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, c in enumerate(texts):
        col = qcol(c)
        aggs.append(F.count_if(text_to_double(col).isNotNull()).alias(f"ok{i}"))
        aggs.append(F.count_if(col.isNotNull() & (col != "")).alias(f"ne{i}"))
    one = df.agg(*aggs)
    long = unpivot_row(one, "column_name",
                       [(c, F.struct(F.col(f"ok{i}").alias("ok"), F.col(f"ne{i}").alias("ne")))
                        for i, c in enumerate(texts)], "v")
    ratio = F.col("v.ok") / F.col("v.ne")
    return (long.where((F.col("v.ne") > 0) & (ratio > F.lit(threshold)))
            .select("column_name", F.lit(SUGGEST_FROM).alias("current_type"),
                    F.lit(SUGGEST_TO).alias("suggested_type"),
                    F.round(ratio, 2).alias("confidence")))


def _normalise(conversions) -> list[tuple[str, str]]:
    """Accept dicts / Rows with ``column_name`` and ``new_type`` (or
    ``suggested_type``), or ``(column, type)`` pairs; skip incomplete ones."""
    out = []
    for conv in conversions:
        if isinstance(conv, (tuple, list)):
            col, typ = conv
        else:
            d = conv.asDict() if hasattr(conv, "asDict") else dict(conv)
            col = d.get("column_name")
            typ = d.get("new_type") or d.get("suggested_type")
        if not col or not typ:
            continue
        out.append((col, typ))
    cols = [c for c, _ in out]
    if len(set(cols)) != len(cols):
        raise ValueError(f"a column is listed twice in {cols}")
    return out


def _plan(df: DataFrame, conversions):
    """Split conversions into valid ``{col: spark type}`` and errors."""
    valid, errors = {}, {}
    for col, typ in _normalise(conversions):
        if col not in df.columns:
            errors[col] = (typ, f"column {col!r} not found")
            continue
        try:
            valid[col] = (typ, parse_type(typ))
        except ValueError as e:
            errors[col] = (typ, str(e))
    return valid, errors


def convert_types(df: DataFrame, conversions) -> DataFrame:
    """Cast the listed columns; values that do not convert become NULL.
    Column order is kept. Unknown columns or types are skipped (they appear
    as ``Failed`` in :func:`conversion_report`)."""
    valid, _ = _plan(df, conversions)
    return df.select(*[
        guarded_cast(qcol(f.name), f.dataType, valid[f.name][1]).alias(f.name)
        if f.name in valid else qcol(f.name) for f in df.schema.fields])


def conversion_report(df: DataFrame, conversions) -> DataFrame:
    """``(column_name, status, new_type, conversion_failures, error)``.

    ``conversion_failures`` counts values that were present before and NULL
    after the cast; all columns are counted in one ``agg`` over ``df`` (the
    frame *before* conversion)."""
    valid, errors = _plan(df, conversions)
    spark = df.sparkSession
    schema = ("column_name string, status string, new_type string, "
              "conversion_failures bigint, error string")
    parts = []
    if valid:
        names = list(valid)
        aggs = []
        for i, c in enumerate(names):
            src = qcol(c)
            cast = guarded_cast(src, df.schema[c].dataType, valid[c][1])
            aggs.append(F.count_if(src.isNotNull() & cast.isNull()).alias(f"f{i}"))
        one = df.agg(*aggs)
        long = unpivot_row(one, "column_name",
                           [(c, F.struct(F.lit(valid[c][0]).alias("t"), F.col(f"f{i}").alias("f")))
                            for i, c in enumerate(names)], "v")
        parts.append(long.select("column_name", F.lit("Success").alias("status"),
                                 F.col("v.t").alias("new_type"),
                                 F.col("v.f").cast("bigint").alias("conversion_failures"),
                                 F.lit(None).cast("string").alias("error")))
    if errors:
        parts.append(spark.createDataFrame(
            [(c, "Failed", t, None, e) for c, (t, e) in errors.items()], schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def convert_with_report(df: DataFrame, conversions):
    """P6 + P7: the converted frame and its report (report lazily built from
    the input frame)."""
    return convert_types(df, conversions), conversion_report(df, conversions)


def suggested_conversions(suggestions) -> list[dict]:
    """Every suggestion selected by default, as conversion entries.
    ``suggestions`` is the (small) frame from :func:`suggest_types` or rows."""
    rows = suggestions.collect() if isinstance(suggestions, DataFrame) else suggestions
    out = []
    for r in rows:
        d = r.asDict() if hasattr(r, "asDict") else dict(r)
        out.append({"column_name": d["column_name"], "new_type": d["suggested_type"]})
    return out
