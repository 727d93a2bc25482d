"""Helpers shared by the operators: written tables in the cluster's shared
folder, and reading the driver's tables."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.session import shared_scratch

# Labels are learned only from rows whose crc32(doc_id as text) mod FOLDS is not 0.
FOLDS = 5


def ready(spark: SparkSession) -> None:
    """Let Python workers find this package where they share the driver's files
    (local sessions); elsewhere it is installed or sent with ``--py-files``."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


SLICE = 512
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "array<int>": pa.list_(pa.int32())}
_SPARK = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
          "array<int>": T.ArrayType(T.IntegerType())}


def map_texts(docs: DataFrame, keep: list[str], text_col: str, make: Callable, out: dict[str, str]) -> DataFrame:
    """The columns ``keep`` as they are, and the columns ``out`` (name to type) that
    ``make()``, called once per task, computes from each batch's texts: a function
    from a list of texts to a list of values for each column. Names may clash: the
    result's columns are found by place."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    names = [f"c{i}" for i in range(len(keep))] + [f"r{i}" for i in range(len(out))]
    types = list(out.values())

    def run(batches):
        work = make()
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), SLICE):  # few texts at a time as Python strings
                b = whole.slice(at, SLICE)
                results = work(b.column(len(keep)).to_pylist())
                arrays = [b.column(i) for i in range(len(keep))]
                arrays += [pa.array(r, type=_ARROW[t]) for r, t in zip(results, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [kinds[c] for c in keep] + [_SPARK[t] for t in types])])
    picked = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    return (docs.select(*picked, F.col(f"`{text_col}`").alias("t")).mapInArrow(run, schema)
            .toDF(*keep, *out))


def portions(batches, text_of: Callable, limit: int = 1 << 22):
    """Pandas batches cut where their texts exceed ``limit`` characters, so that what a
    task makes of a batch stays small."""
    for batch in batches:
        start, total = 0, 0
        for i, row in enumerate(text_of(batch)):
            size = sum(len(t or "") for t in row)
            if total and total + size > limit:
                yield batch.iloc[start:i]
                start, total = i, 0
            total += size
        if start < len(batch):
            yield batch.iloc[start:]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Written tables in the shared checkpoint folder.

    ``keep`` writes a frame and rereads it, so that lost executors cost a read
    and not a recomputation; ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = shared_scratch(spark, f"{name}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
