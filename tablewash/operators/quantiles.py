"""Exact quantiles that scale (used by A7 median, A14 quartiles, I2 bounds).

Spark's exact ``percentile`` keeps a value->count map per group and merges
them in one task: fine for a bounded column, an OOM for a high-cardinality
column at 100 TB. Here the wanted order statistics are found by a radix descent
over order-preserving 64-bit keys (the bits of a double, with the sign turned so that
unsigned order is numeric order), all columns and ranks together:

1. One ``agg``: non-NULL count, minimum and maximum of every column. Callers can add
   their own aggregates to this scan.
2. A pass cuts the key range that holds a wanted rank into at most ``CELLS`` equal cells.
   Each task counts its values per cell (numpy over Arrow batches), Spark adds the counts,
   and a running sum over the cells tells in which one each rank lies; that cell is
   the next range. A task sends at most ``CELLS`` rows per range, whatever the values
   are; ties cost nothing, since a range of one key is an answer. 64 bits and 12 bits a
   pass bound the passes by six, for any column of any size.
3. As soon as every range holds at most ``band_rows`` values, one last job ranks the
   values inside the ranges (a window whose partitions are bounded by ``band_rows``).

When the ranges together hold a small share of the values but are not done, the
values in them are written once to the shared checkpoint folder (if the session names
one) and the remaining passes read only these.

Only the wanted cells and values reach the driver. Interpolation is linear
between the order statistics at ``floor(h)`` and ``floor(h) + 1`` with
``h = (n - 1) q``, the rule of pandas ``describe`` and SQL ``quantile_cont``.
NaN counts as missing.
"""

from __future__ import annotations

import math
import struct
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, require_columns
from ..session import shared_scratch

BAND_ROWS = 200_000
BITS = 12
CELLS = 1 << BITS
NARROW = 0.1  # once the ranges hold at most this share of all values they are written apart


def _key(v: float) -> int:
    """A number that orders as the double does (-0.0 is 0.0)."""
    bits = struct.unpack("<Q", struct.pack("<d", v + 0.0))[0]
    return bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ 0xFFFFFFFFFFFFFFFF
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _shift(low: int, high: int) -> int:
    """How many low bits a cell of the key range [low, high] spans."""
    return max(0, (high - low).bit_length() - BITS)


class _Target:
    """Search state of one order statistic: the rank ``rel`` among the ``size`` values
    whose keys lie in [low, high]."""
    __slots__ = ("low", "high", "rel", "size")

    def __init__(self, low, high, rel, size):
        self.low, self.high, self.rel, self.size = low, high, rel, size


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    band_rows: int = BAND_ROWS, extra_aggs: list | None = None):
    """``{column: [quantile for each prob]}``; ``None`` for an all-NULL column.

    With ``extra_aggs`` (aggregate columns over ``df``) they are computed in
    the first scan and ``(quantiles, row)`` is returned.
    """
    require_columns(df, columns)
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability {p} outside [0, 1]")
    cols = list(dict.fromkeys(columns))
    xs = [nan_to_null(c, df.schema[c].dataType).cast("double") for c in cols]
    aggs = list(extra_aggs or [])
    for i, x in enumerate(xs):
        aggs += [F.count(x).alias(f"__n{i}"), F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
    first = df.agg(*aggs).first() if aggs else None

    plan: dict[str, list] = {c: [] for c in cols}
    targets: dict[tuple[int, int], _Target] = {}
    for i, c in enumerate(cols):
        n = int(first[f"__n{i}"])
        for p in probs if n else []:
            h = (n - 1) * p
            r0 = int(math.floor(h))
            plan[c].append((r0, min(r0 + 1, n - 1), h - r0))
            for r in plan[c][-1][:2]:
                targets[i, r] = _Target(_key(first[f"__lo{i}"]), _key(first[f"__hi{i}"]), r, n)
    wanted = _search(df.select(*[x.alias(f"q{i}") for i, x in enumerate(xs)]), targets, band_rows)

    out = {}
    for i, c in enumerate(cols):
        vals = []
        for r0, r1, frac in plan[c]:
            v0, v1 = wanted[i, r0], wanted[i, r1]
            vals.append(v0 if frac == 0.0 or v0 == v1 else v0 + (v1 - v0) * frac)
        out[c] = vals or [None] * len(probs)
    return (out, first) if extra_aggs else out


def _search(wide: DataFrame, targets: dict, band_rows: int) -> dict:
    """The value of each target (column place, rank)."""
    wanted: dict = {}
    rows = sum({i: t.size for (i, _), t in targets.items()}.values())
    apart = None
    try:
        while True:
            for k, t in list(targets.items()):
                if t.low == t.high:
                    wanted[k] = _value(t.low)
                    del targets[k]
            if not targets:
                return wanted
            ranges = sorted({(i, t.low, t.high): t.size for (i, _), t in targets.items()}.items())
            place = {r: g for g, (r, _) in enumerate(ranges)}
            if all(size <= band_rows for _, size in ranges):
                found = _ranked(wide, [r for r, _ in ranges], [(place[i, t.low, t.high], t.rel) for (i, _), t in targets.items()])
                return wanted | {k: found[place[k[0], t.low, t.high], t.rel] for k, t in targets.items()}
            if apart is None and sum(size for _, size in ranges) <= NARROW * rows:
                apart = _written(wide, [r for r, _ in ranges])
                wide = apart.frame if apart else wide
            cells = _cells(wide, [r for r, _ in ranges], [(place[i, t.low, t.high], t.rel) for (i, _), t in targets.items()])
            for (i, r), t in list(targets.items()):
                cell, before, size = cells[place[i, t.low, t.high], t.rel]
                s = _shift(t.low, t.high)
                low = t.low + (cell << s)
                targets[i, r] = _Target(low, min(t.high, low + (1 << s) - 1), t.rel - before, size)
    finally:
        if apart:
            apart.drop()


def _keyed(ranges: list):
    """A function from an Arrow batch to (range, keys of the values in it) pairs. The batch
    has a column of doubles ``q<place>`` for each place, or rows of place ``c`` and value ``v``."""
    by_column: dict = {}
    for g, (i, low, high) in enumerate(ranges):
        by_column.setdefault(i, []).append((g, low, high))

    def run(batch):
        import numpy as np

        long = batch.schema.names == ["c", "v"]
        column = batch.column(0).to_numpy(zero_copy_only=False) if long else None
        for i, own in by_column.items():
            x = batch.column("v" if long else f"q{i}").to_numpy(zero_copy_only=False)
            x = x[column == i] if long else x
            x = x[~np.isnan(x)] + 0.0
            bits = x.view(np.uint64)
            keys = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
            for g, low, high in own:
                yield g, keys[(keys >= np.uint64(low)) & (keys <= np.uint64(high))]

    return run


def _needed(frame: DataFrame, ranges: list) -> DataFrame:
    own = sorted({i for i, _, _ in ranges})
    return frame if frame.columns == ["c", "v"] else frame.select(*[f"q{i}" for i in own])


def _cells(frame: DataFrame, ranges: list, ranks: list) -> dict:
    """For each (range, rank): its cell, the values of the range in earlier cells, and in this one."""
    inside = _keyed(ranges)
    cuts = [(low, _shift(low, high)) for _, low, high in ranges]

    def count(batches):
        import numpy as np
        import pyarrow as pa

        counts: dict = {}
        for b in batches:
            for g, keys in inside(b):
                if len(keys):
                    cell = ((keys - np.uint64(cuts[g][0])) >> np.uint64(cuts[g][1])).astype(np.int64)
                    if g not in counts:
                        counts[g] = np.zeros(CELLS, dtype=np.int64)
                    counts[g] += np.bincount(cell, minlength=CELLS)
        for g, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, dtype=np.int32)), pa.array(at), pa.array(n[at])],
                                             names=["g", "cell", "n"])

    w = Window.partitionBy("g").orderBy("cell")
    total = (_needed(frame, ranges).mapInArrow(count, "g int, cell long, n long").groupBy("g", "cell").agg(F.sum("n").alias("n"))
             .withColumn("before", F.sum("n").over(w) - F.col("n")))
    return {(r["g"], rank): (r["cell"], r["before"], r["n"]) for r in _with_ranks(total, ranks).collect() for rank in r["ranks"]}


def _with_ranks(counted: DataFrame, ranks: list) -> DataFrame:
    """Of rows (range ``g``, ``before``, ``n``) those that hold a wanted rank, with their ``ranks``."""
    own: dict = {}
    for g, rank in set(ranks):
        own.setdefault(g, []).append(rank)
    of = F.create_map(*[x for g, r in own.items() for x in (F.lit(g), F.array(*[F.lit(v).cast("long") for v in r]))])
    held = F.filter(F.element_at(of, F.col("g")), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    return counted.withColumn("ranks", held).where(F.size("ranks") > 0)


def _ranked(frame: DataFrame, ranges: list, ranks: list) -> dict:
    """The value of each (range, rank), from the values inside the ranges."""
    own = _inside(frame, ranges).groupBy("g", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy("v")
    counted = own.withColumn("before", F.sum("n").over(w) - F.col("n"))
    return {(r["g"], rank): r["v"] for r in _with_ranks(counted, ranks).collect() for rank in r["ranks"]}


def _inside(frame: DataFrame, ranges: list) -> DataFrame:
    """``g, c, v``: the values inside the ranges, with the number of the range and the place of the column."""
    long = frame.columns == ["c", "v"]
    found = []
    for g, (i, low, high) in enumerate(ranges):
        x = F.col("v" if long else f"q{i}")
        # no value has the key of -0.0, and 0.0 is not below it
        fits = x.between(_value(low), _value(high - (high == _key(0.0) - 1)))
        found.append((g, i, (F.col("c") == i) & fits if long else fits, x))
    some = found[0][2]
    for _, _, fits, _ in found[1:]:
        some = some | fits
    rows = F.array(*[F.when(fits, F.struct(F.lit(g).alias("g"), F.lit(i).alias("c"), (x + 0.0).alias("v"))) for g, i, fits, x in found])
    return frame.where(some).select(F.explode(rows).alias("r")).where("r IS NOT NULL").select("r.*")


class _Written:
    """The values inside ranges as rows (column place, value), in the shared folder."""

    def __init__(self, df: DataFrame, path: str):
        self.spark, self.path = df.sparkSession, path
        df.write.mode("overwrite").parquet(path)
        self.frame = self.spark.read.parquet(path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _written(wide: DataFrame, ranges: list) -> _Written | None:
    """``None`` where the session names no shared folder."""
    try:
        path = shared_scratch(wide.sparkSession, f"quantiles-{uuid.uuid4().hex}")
    except ValueError:
        return None
    return _Written(_inside(wide, ranges).select("c", "v"), path)


def median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, [column], [0.5])[column][0]
