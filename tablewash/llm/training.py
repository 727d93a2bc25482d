"""Labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``text, y`` of at most ``rows`` labelled documents outside the held-out
    fold, chosen by the hash of their id (a documented bound of the fit).
    Rows without id, text or label are left out; only the bounded list of ids is
    broadcast."""
    chosen = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
              .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows))
    return (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(chosen), "doc_id").select("text", "y"))
