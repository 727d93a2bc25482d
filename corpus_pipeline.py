"""A training-corpus pipeline over ``documents``: bad documents go, repeated line
runs go, one document of each group of near copies stays, documents with benchmark
items go, and the rest is encoded to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet to the shared checkpoint folder and reread as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewash.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from tablewash.llm.common import Scratch, ready, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    ready(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_run_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of two lines or more."""
    return line_dedup.remove_runs(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8."""
    ready(spark)
    return jaccard_join.keep_first(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the hashes of a full round trip. Small tables:
    Python workers keep them while the stages of another run need the memory."""
    ready(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN, with_ids=True, cache=60_000)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_run_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", token_ids),
]

# The classifier and the tokenizer are beyond SQL; the tests hold the pipeline
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
