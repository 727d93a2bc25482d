"""Row-local cleaning on a streaming DataFrame.

The reference has no streaming code. The cleaning rules that look at one
row at a time -- renaming, trimming / NULL-like / casing, type conversion,
dropping columns and filling NULLs with *known* values -- are plain
projections, so they apply unchanged to a ``readStream`` frame. Rules that
need the whole table (duplicates, statistics) are refused here: on a stream
they would need state without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol
from ..operators.clean import auto_clean, drop_columns
from ..operators.convert import convert_types
from ..operators.impute import fill_literal


def read_csv_stream(spark: SparkSession, directory: str, columns: list[str],
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """New CSV files in ``directory`` as a stream of all-text rows (the header
    is skipped; ``''`` is NULL). A stream needs its schema up front."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = (spark.readStream.schema(schema).option("header", "true")
              .option("escape", '"').option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.csv(directory)
    return df.select(*[F.nullif(qcol(c), F.lit("")).alias(c) for c in columns])


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now into Parquet files at ``path`` and
    stop (``availableNow``); progress is kept in ``checkpoint`` so a restarted
    run resumes where it stopped. Both folders must be shared by the cluster."""
    q = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def clean_stream(df: DataFrame, auto: bool = True, conversions=None,
                 fill_values: dict | None = None, drop: list[str] | None = None,
                 **auto_kw) -> DataFrame:
    """Apply the row-local steps in the flow's order."""
    if not df.isStreaming:
        raise ValueError("clean_stream expects a streaming DataFrame")
    cur = auto_clean(df, **auto_kw) if auto else df
    if conversions:
        cur = convert_types(cur, conversions)
    if fill_values:
        unknown = [c for c in fill_values if c not in cur.columns]
        if unknown:
            raise ValueError(f"unknown column(s) {unknown}")
        cur = cur.select(*[F.coalesce(qcol(f.name), fill_literal(fill_values[f.name], f.dataType))
                           .alias(f.name) if f.name in fill_values else qcol(f.name)
                           for f in cur.schema.fields])
    if drop:
        cur = drop_columns(cur, drop)
    return cur
