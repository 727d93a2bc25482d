"""Duplicates: count (A3), exact-duplicate sample (W1), entity key heuristic
(A11), entity duplicates (A12, A13, J1, W3), removal (U1), report (U2).

Scale notes.

* One plan for every input size: rows are grouped on all columns after map-side
  partial aggregation; nothing is broadcast and no size switches the plan.
* Skew. Every grouping starts with map-side partial aggregation, so a row or
  key repeated a billion times is one buffer entry per task before the
  shuffle.
* Entity duplicates. "More than one *distinct* row per key" is decided per
  key from min/max/count of every column (fixed-width schemas), or from the
  range of the row hash with an exact re-check of keys whose rows share one
  hash -- never a ``DISTINCT`` of all rows.
* Samples are ``TakeOrderedAndProject`` (a per-task top-n, never a full
  sort), ordered on all columns so results are reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol, require_columns

# Name fragments that mark a likely entity key (matched as
# substrings of the lower-cased column name, in column order).
ENTITY_HINTS = ("id", "name", "customer_id", "user_id", "customerid", "userid")

# Report messages.
EXACT_MSG = "These are identical rows and are generally safe to remove."
ENTITY_MSG = ("These rows may share a common ID in '{col}' but have different "
              "data elsewhere. Review carefully.")

STRATEGIES = ("remove_exact_duplicates",)

# Copies of one row that one task makes; a hotter row is cut into chunks first.
COPIES = 1 << 16


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` plus ``__h1``: a 64-bit hash of all columns and of their NULL
    pattern (hashes skip NULLs, so the pattern keeps ``(NULL, 1)`` and
    ``(1, NULL)`` apart). Equal rows always get equal hashes; different rows
    rarely do (a few dozen pairs among 10^12 rows), and those only cost an
    exact check."""
    cols = [qcol(c) for c in df.columns]
    masks = []
    for start in range(0, len(cols), 62):
        m = F.lit(0).cast("long")
        for i, c in enumerate(cols[start:start + 62]):
            m = m + F.when(c.isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        masks.append(m)
    return df.select(*cols, F.xxhash64(*cols, *masks).alias("__h1"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every distinct row seen more than once with its ``count``."""
    return df.groupBy(*[qcol(c) for c in df.columns]).count().where(F.col("count") > 1)


def _copies(groups: DataFrame, cols: list[str], copies: Column) -> DataFrame:
    """Each group's row ``copies`` times: first as chunks of at most COPIES, which
    are dealt out evenly, then the copies of each chunk. No row's copies ever
    stand in one array or one task."""
    last = F.floor((copies - 1) / COPIES).cast("bigint")
    chunks = groups.select(*[qcol(c) for c in cols], copies.alias("__n"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__chunk"))
    size = F.least(F.lit(COPIES).cast("bigint"), F.col("__n") - F.col("__chunk") * COPIES)
    return (chunks.withColumn("__n", size).repartition(*[qcol(c) for c in cols], F.col("__chunk"))
            .withColumn("__rep", F.explode(F.sequence(F.lit(1).cast("bigint"), "__n")))
            .select(*[qcol(c) for c in cols]))


def _order(cols: list[str]) -> list[Column]:
    return [qcol(c).asc_nulls_first() for c in cols]


def exact_duplicate_rows(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Rows that occur more than once, each repeated as often as it
    occurs, ordered by all columns; the first ``n`` (all when ``None``, unordered).

    A group contributes at most ``n`` copies: the first ``n`` rows of the
    result are the same either way, and a hot row never expands to millions.
    """
    groups = duplicate_groups(df)
    if n is None:
        return _copies(groups, df.columns, F.col("count"))
    return _sample(groups, df.columns, n)


def _sample(groups: DataFrame, cols: list[str], n: int) -> DataFrame:
    # at least two copies of each group: n groups hold the first n rows
    first = groups.orderBy(*_order(cols)).limit(n)
    out = _copies(first, cols, F.least(F.col("count"), F.lit(n).cast("bigint")))
    return out.orderBy(*_order(cols)).limit(n)


def _repeats(df: DataFrame, column: str) -> DataFrame:
    """One row: whether the column repeats a value or has a NULL."""
    groups = df.groupBy(qcol(column).alias("k")).count()
    return groups.agg(F.coalesce(F.max((F.col("count") > 1) | F.col("k").isNull()), F.lit(False)).alias("r"))


def entity_key(df: DataFrame, key: str | None = None,
               hints: tuple[str, ...] = ENTITY_HINTS) -> str | None:
    """The column to check for entity duplicates.

    A given ``key`` must exist. Otherwise the first column (in order) whose
    lower-cased name contains a hint and that has a repeated value (or a
    NULL, which a count of distinct values skips) is chosen; candidates are tested
    one by one, and the first hit ends the search.
    """
    if key is not None:
        require_columns(df, [key])
        return key
    for c in df.columns:
        if any(h in c.lower() for h in hints) and _repeats(df, c).first()["r"]:
            return c
    return None


def entity_key_df(df: DataFrame, hints: tuple[str, ...] = ENTITY_HINTS) -> DataFrame:
    """A11 as a one-row frame ``(checked_column)`` (NULL when none)."""
    return df.sparkSession.range(1).select(F.lit(entity_key(df, hints=hints)).cast("string").alias("checked_column"))


def _fixed_width(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType,
                           T.TimestampNTZType)) and not (
        isinstance(dt, T.DecimalType) and dt.precision > 18)


def entity_duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """A12+A13: non-NULL keys that have more than one **distinct** row.

    Two exact plans, both hash aggregations only:

    * every other column fixed-width: one ``groupBy(key)`` keeping count, min,
      max and non-NULL count of each column; a key qualifies when it has
      more than one row and some column is not constant within the group;
    * otherwise (text, arrays...; their min/max would force a sort-based
      aggregate): per key the count and the min/max of the 64-bit row hash.
      Two hashes prove two different rows; keys whose rows share one hash are
      re-checked exactly by grouping just their rows on all columns (a
      ``left_semi`` join; AQE broadcasts a small key set and splits a skewed
      key). No full-width shuffle of the other rows.
    """
    return _entity_keys(df, key).select(F.col("__k").alias(key))


def _entity_keys(df: DataFrame, key: str) -> DataFrame:
    """Qualifying keys in a column named ``__k``."""
    require_columns(df, [key])
    others = [c for c in df.columns if c != key]
    k = qcol(key)
    present = df.where(k.isNotNull())
    if all(_fixed_width(df.schema[c].dataType) for c in others):
        n = F.count(F.lit(1))
        aggs = [n.alias("__n")]
        varies = F.lit(False)
        for i, c in enumerate(others):
            x = qcol(c)
            aggs += [F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}"),
                     F.count(x).alias(f"__c{i}")]
            nonconst = ((F.col(f"__c{i}") > 0) & (F.col(f"__c{i}") < F.col("__n"))) | \
                       (F.col(f"__lo{i}") != F.col(f"__hi{i}"))
            varies = varies | F.coalesce(nonconst, F.lit(False))
        grouped = present.groupBy(k.alias("__k")).agg(*aggs)
        return grouped.where((F.col("__n") > 1) & varies).select("__k")
    # Per key: row count and the range of the row hash (fixed-width, so a
    # hash aggregate). Two different hashes prove two different rows; keys
    # whose rows all share one hash (identical rows, or a collision) are
    # checked exactly on all columns, and only their rows are grouped.
    keyed = _keyed(present)
    per = (keyed.groupBy(k.alias("__k"))
           .agg(F.count(F.lit(1)).alias("__n"),
                F.min("__h1").alias("__a1"), F.max("__h1").alias("__b1")))
    differ = F.col("__a1") != F.col("__b1")
    proven = per.where((F.col("__n") > 1) & differ).select("__k")
    alike = per.where((F.col("__n") > 1) & ~differ).select("__k")
    rows = _semi(present, key, alike)
    checked = (rows.groupBy(*[qcol(c) for c in df.columns]).count()
               .groupBy(qcol(key).alias("__k")).agg(F.count(F.lit(1)).alias("__d"))
               .where(F.col("__d") > 1).select("__k"))
    return proven.unionByName(checked)


def _semi(df: DataFrame, key: str, keys: DataFrame, broadcast: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys.__k`` (NULL never matches)."""
    right = F.broadcast(keys) if broadcast else keys
    return df.join(right, qcol(key) == right["__k"], "left_semi")


def entity_duplicates(df: DataFrame, key: str, n: int | None = 10) -> DataFrame:
    """J1+W3: rows whose key is in :func:`entity_duplicate_keys`, ordered by the
    key (then the other columns, for a stable sample); first ``n``.

    Each qualifying key has at least two rows, so the first ``n`` rows come
    from the ``ceil(n / 2)`` smallest keys: only those few keys are joined
    (a broadcast of a bounded set), and the table is never shuffled for the
    sample. ``n=None`` returns all such rows (a semi join on all keys).
    """
    keys = _entity_keys(df, key)
    cols = [key] + [c for c in df.columns if c != key]
    if n is None:
        return _semi(df, key, keys)
    first_keys = keys.orderBy(F.col("__k").asc()).limit((n + 1) // 2)
    rows = _semi(df, key, first_keys, broadcast=True)
    return rows.orderBy(*_order(cols)).limit(n)


def remove_duplicates(df: DataFrame, strategy: str = "remove_exact_duplicates") -> DataFrame:
    """Drop exact duplicate rows: one shuffle of the rows that are left after
    map-side de-duplication."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; supported: {STRATEGIES}")
    return df.dropDuplicates()


@dataclass
class DuplicateReport:
    count: int
    exact_sample: list[dict]
    checked_column: str | None
    entity_sample: list[dict] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {
            "exact_duplicates": {"count": self.count, "message": EXACT_MSG,
                                 "sample": self.exact_sample},
            "entity_duplicates": {"checked_column": self.checked_column,
                                  "message": ENTITY_MSG.format(col=self.checked_column),
                                  "sample": self.entity_sample},
        }


def find_duplicates(df: DataFrame, key: str | None = None, n: int = 10) -> DuplicateReport:
    """Duplicate count, exact sample, checked column and entity sample.
    Only the count, the column name and at most ``2 n`` rows reach the driver."""
    # only groups seen more than once add to the count, and the sample is
    # drawn from the same groups: group once, keep those, use them twice
    groups = duplicate_groups(df).persist()
    try:
        count = int(groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0])
        exact = [r.asDict(recursive=True) for r in _sample(groups, df.columns, n).collect()] if count else []
    finally:
        groups.unpersist()
    col = entity_key(df, key)
    ent = [r.asDict(recursive=True) for r in entity_duplicates(df, col, n).collect()] \
        if col else []
    return DuplicateReport(count, exact, col, ent)
