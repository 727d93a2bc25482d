"""Exact dedup: documents of equal text, grouped by a 128-bit content hash and
compared byte by byte.

Texts are equal when they are identical after each run of blanks (code points 9
to 13 and 32) became one space. The hashes alone are counted first, so the texts
that nobody shares are never shuffled. The texts whose hash occurs more than once
are then grouped by hash *and* text: a grouping compares its keys in full, so two
texts that merely share a hash stay apart, and each task sends a text that it holds
a thousand times once. A document finds its group by content hash and SHA-256; that
this pair names one text only is checked on the compared groups.

Null texts count as empty. Rows without id belong to the group of their text but
come after all ids: they stay only where no row of the group has an id (then
``keep_id`` is null). Rows that share both id and text are one document: the report
marks them all as kept, ``remove_copies`` leaves one of them. Other columns, by
whatever name, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch

# Runs that are not a single space already.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
# Rows of at most 100 bytes or so that a join may broadcast; beyond, it shuffles both
# sides, and adaptive execution splits a hot group.
BROADCAST_ROWS = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def _joinable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hashed(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    """``row`` (all columns), ``id``, ``t`` (normalised text), ``h`` and ``s`` (its hashes)."""
    own = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"),
                      normalised(F.col(f"`{text_col}`")).alias("t"))
    return own.select("row", "id", "t", hash_of(F.col("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("s"))


def _same(own: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``h, s, keep, n`` of every text whose content hash occurs more than once."""
    met = scratch.keep(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "met")
    again = own.select("id", "t", "h").join(_joinable(met), "h", "left_semi")
    same = scratch.keep(again.groupBy("h", "t").agg(F.min("id").alias("keep"), F.count("*").alias("n"))
                        .select("h", F.unhex(F.sha2("t", 256)).alias("s"), "keep", "n"), "same")
    if same.groupBy("h", "s").agg(F.count("*").alias("m")).where("m > 1").limit(1).count():
        raise ValueError("two different texts share their content hash and their SHA-256")
    scratch.drop("met")
    return same


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    scratch = Scratch(docs.sparkSession, "exact")
    own = _hashed(docs, id_col, text_col, hash_of)
    rows = scratch.keep(own.select("id", "h", "s"), "rows")
    same = _joinable(_same(own, rows, scratch))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return rows.join(same, ["h", "s"], "left").select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row of each text, all its columns kept: of the smallest id and, where
    rows share id and text, the one whose columns have the smallest hash."""
    scratch = Scratch(docs.sparkSession, "exact")
    own = _hashed(docs, id_col, text_col, hash_of)
    same = _joinable(_same(own, scratch.keep(own.select("h"), "rows"), scratch))
    scratch.drop("rows")
    placed = own.drop("t").join(same, ["h", "s"], "left")
    alone = placed.where("n IS NULL").select("row")
    first = (placed.where("n IS NOT NULL AND id <=> keep").groupBy("h", "s")
             .agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return alone.union(first).select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
