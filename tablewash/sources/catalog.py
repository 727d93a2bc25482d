"""Catalog tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

PROJECT_PREFIX = "project_"


def project_table_name(project_id) -> str:
    return f"{PROJECT_PREFIX}{project_id}"


def _quoted(name: str) -> tuple[str, str]:
    """The database part of a table name, quoted and with its dot, and the bare name."""
    *base, table = [p.strip("`") for p in name.split(".")]
    return "".join(f"`{p}`." for p in base), table


def save_table(df: DataFrame, name: str, mode: str = "overwrite",
               fmt: str = "parquet") -> str:
    """Write ``df`` as a named catalog table (replacing it by default).

    A table that exists is replaced as a whole or not at all: the rows go to a new
    table first, and only when all are written do the names change. If the write fails,
    the old table is as it was; if the last renaming fails, the old one gets its name
    back. ``df`` may read the table that it replaces. A view is never replaced.
    """
    spark = df.sparkSession
    if mode != "overwrite" or not spark.catalog.tableExists(name) or (
            spark.catalog.getTable(name).tableType in ("VIEW", "TEMPORARY")):
        df.write.mode(mode).format(fmt).saveAsTable(name)
        return name
    base, table = _quoted(name)
    own, tag = f"{base}`{table}`", uuid.uuid4().hex
    new, old = (f"{base}`{table}__{kind}_{tag}`" for kind in ("new", "old"))
    try:
        df.write.format(fmt).saveAsTable(new)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    spark.sql(f"ALTER TABLE {own} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {new} RENAME TO {own}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {own}")
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    return name


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables in the current (or given) database."""
    return [t.name for t in spark.catalog.listTables(database)]


def drop_tables_with_prefix(spark: SparkSession, prefix: str, database: str | None = None) -> int:
    """Drop every table or view whose name starts with ``prefix``; returns the count.
    The prefix must be non-empty."""
    if not prefix:
        raise ValueError("prefix must be non-empty")
    kinds = []
    for t in spark.catalog.listTables(database):
        if t.name.startswith(prefix):
            view = t.tableType in ("TEMPORARY", "VIEW")
            kinds.append(("VIEW" if view else "TABLE", f"`{t.database}`.`{t.name}`" if t.database else f"`{t.name}`"))
    for kind, name in kinds:  # views first, they may read the tables
        if kind == "VIEW":
            spark.sql(f"DROP VIEW IF EXISTS {name}")
    for kind, name in kinds:
        if kind == "TABLE":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(kinds)
