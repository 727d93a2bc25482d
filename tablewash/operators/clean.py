"""Auto clean (P1-P5), drop columns (P8) and the not-null filter (P10).

All value rules are one projection: trim, NULL-like to NULL and casing fuse
into a single expression per text column, so the whole step is a narrow
transformation (no shuffle) that also works on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_text, qcol, require_columns
from ..functions.names import normalize_names
from ..functions.text import sql_upper

# Strings read as missing after trimming (case-sensitive).
NULL_LIKE = ("N/A", "NA", "null", "Null", "?", "", " ")

# Operation-log messages.
RENAME_MSG = "Renamed column '{old}' to '{new}'."
VALUES_MSG = "Cleaned whitespace, unified nulls, and standardized casing for all text columns."

_CASINGS = ("upper", "lower", "title", None)


def rename_columns(df: DataFrame, on_collision: str = "raise") -> DataFrame:
    """snake_case every column name in one ``toDF``."""
    return df.toDF(*normalize_names(df.columns, on_collision))


def clean_text(c: Column, null_like=NULL_LIKE, casing: str | None = "upper") -> Column:
    """P2-P4 for one text column: trim spaces, NULL-like to NULL, recase."""
    if casing not in _CASINGS:
        raise ValueError(f"casing must be one of {_CASINGS}")
    t = F.trim(c)
    t = F.when(~t.isin(*null_like), t)         # NULL input stays NULL
    if casing == "upper":
        t = sql_upper(t)
    elif casing == "lower":
        t = F.lower(t)
    elif casing == "title":
        t = F.initcap(t)
    return t


def clean_values(df: DataFrame, null_like=NULL_LIKE, casing: str | None = "upper",
                 columns: list[str] | None = None) -> DataFrame:
    """P2-P4 over all text columns (or the given ones) in one ``select``."""
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if is_text(f.dataType)}
    if columns is not None:
        require_columns(df, columns)
    return df.select(*[
        clean_text(qcol(f.name), null_like, casing).alias(f.name)
        if f.name in targets and is_text(f.dataType) else qcol(f.name)
        for f in df.schema.fields])


def auto_clean(df: DataFrame, null_like=NULL_LIKE, casing: str | None = "upper",
               on_collision: str = "raise", extra_null_like=()) -> DataFrame:
    """P5: rename columns, then trim / unify NULLs / recase every text column."""
    return auto_clean_with_log(df, null_like, casing, on_collision, extra_null_like)[0]


def auto_clean_with_log(df: DataFrame, null_like=NULL_LIKE, casing: str | None = "upper",
                        on_collision: str = "raise", extra_null_like=()):
    """P5 with its operation log (built from metadata; no job runs)."""
    old = df.columns
    renamed = rename_columns(df, on_collision)
    log = [RENAME_MSG.format(old=o, new=n) for o, n in zip(old, renamed.columns) if o != n]
    cleaned = clean_values(renamed, tuple(null_like) + tuple(extra_null_like), casing)
    log.append(VALUES_MSG)
    return cleaned, log


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the named columns; every name must exist; empty list = no-op."""
    if not columns:
        return df
    require_columns(df, columns)
    drop = set(columns)
    return df.select(*[qcol(c) for c in df.columns if c not in drop])


def drop_columns_log(columns: list[str]) -> dict:
    if not columns:
        return {"status": "skipped", "message": "No columns specified to drop."}
    return {"status": "success",
            "message": f"Successfully dropped columns: {', '.join(columns)}."}


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """P10: keep rows where every given column is not NULL."""
    require_columns(df, columns)
    cond = F.lit(True)
    for c in columns:
        cond = cond & qcol(c).isNotNull()
    return df.where(cond)
