"""CSV records that hold newlines, read by as many tasks as the file has splits.

Spark's reader must take such a file in one task, since a split cannot tell whether
it begins inside a quoted field. Here that is found out first:

1. Each line is a map of two states (outside quotes, inside a quoted field): a pattern
   tells in which state it ends for either state it may begin in. Lines without a
   quote leave the state as it is. A split's map is the composition of its lines'.
2. The state at the start of each split is a prefix composition over the splits of its
   file: the last split whose end does not depend on its start decides, and the
   splits that swap the states after it. One row per split takes part.
3. Lines are joined to records wherever one begins outside quotes. The part of a
   record that crosses a split leaves apart; the few such parts are put together by file
   and place, and all records are parsed by Spark's CSV expression.

Lines and records stay on the tasks that read them; only parts of cut records are
shuffled. A record that is never closed runs to the end of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A join may broadcast so many splits that begin inside quotes (24 bytes each).
BROADCAST_SPLITS = 1_000_000
_LINE = "file long, block long, value string, outside boolean, inside boolean"
_PIECE = "file long, block long, kind int, first boolean, record string"
# Kinds of pieces: a whole record, the end of a cut one, a part from the middle of one
# that fills a split, and the beginning of one.
WHOLE, END, MIDDLE, BEGIN = range(4)


def _lines(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """Lines of all files, in order within each split; ``outside`` and ``inside``: whether
    a line ends inside a quoted field if it begins outside or inside one."""
    s = f"\\x{{{ord(sep):x}}}"
    body = '[^"]*+(?:""[^"]*+)*+'  # of a quoted field, up to the quote that closes it
    fields = f'(?:(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'
    opened = f'{fields}"{body}\\z'
    text = F.col("value")
    quote = text.contains('"')
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text,
                    F.when(quote, text.rlike(f"^{opened}")).otherwise(False).alias("outside"),
                    F.when(quote, text.rlike(f'^{body}\\z|^{body}"[^{s}]*+{s}{opened}')).otherwise(True).alias("inside")))


def _split_maps(lines: DataFrame) -> DataFrame:
    """``file, block, outside, inside`` of whole splits."""
    def fold(batches):
        import numpy as np
        import pyarrow as pa

        names = ["file", "block", "outside", "inside"]

        def row(key, state):
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state[0]]), pa.array([state[1]])], names=names)

        key, state = None, (False, True)
        for b in batches:
            file, block, x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(file)]):
                if high == low:
                    continue
                own = (int(file[low]), int(block[low]))
                if own != key:
                    if key is not None:
                        yield row(key, state)
                    key, state = own, (False, True)
                fixed = np.flatnonzero(x[low:high] == y[low:high])
                after = low + fixed[-1] + 1 if len(fixed) else low
                swap = bool((x[after:high] & ~y[after:high]).sum() % 2)
                state = (bool(x[after - 1]) ^ swap,) * 2 if len(fixed) else (state[0] ^ swap, state[1] ^ swap)
        if key is not None:
            yield row(key, state)

    return lines.select("file", "block", "outside", "inside").mapInArrow(
        fold, "file long, block long, outside boolean, inside boolean")


def _inside_at_start(maps: DataFrame) -> DataFrame:
    """``file, block`` of the splits that begin inside a quoted field."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    fixed, swap = F.col("outside") == F.col("inside"), (F.col("outside") & ~F.col("inside")).cast("int")
    counted = maps.withColumn("swaps", F.sum(swap).over(upto))
    # the state behind the last fixed split as if no split had swapped before, swapped by all splits up to here
    base = F.last(F.when(fixed, (F.col("outside").cast("int") + F.col("swaps")) % 2), ignorenulls=True).over(before)
    here = F.coalesce(base, F.lit(0)) + F.coalesce(F.sum(swap).over(before), F.lit(0))
    return counted.select("file", "block", (here % 2 == 1).alias("open")).where("open").select("file", "block")


def _pieces(lines: DataFrame, opened: DataFrame) -> DataFrame:
    """Whole records, and the parts of cut ones with file and block."""
    def build(batches):
        import numpy as np
        import pyarrow as pa

        names = ["file", "block", "kind", "first", "record"]

        def out(key, kind, first, records):
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
                 pa.array(first), records], names=names)

        class Split:
            def __init__(self, key, inside):
                self.key, self.inside, self.begun = key, inside, not inside
                self.held, self.named = [], key[1] != 0  # lines of the record not closed yet; the header has passed

            def flags(self, texts):
                """Whether a record is the first of its file that is not empty."""
                first = [False] * len(texts)
                if not self.named:
                    for i, t in enumerate(texts):
                        if t.as_py().rstrip("\r"):
                            first[i], self.named = True, True
                            break
                return first

            def close(self):
                """The held lines, whose record does not go on in this split."""
                text = pa.array(["\n".join(self.held)], pa.string())
                kind = (WHOLE if self.begun else END) if not self.inside else BEGIN if self.begun else MIDDLE
                first = self.flags(text) if self.begun else [False]
                self.held, self.begun = [], True
                return out(self.key, kind, first, text)

            def add(self, values, x, y):
                n = len(values)
                place = np.arange(n)
                fixed = np.maximum.accumulate(np.where(x == y, place, -1))
                swaps = np.cumsum(x & ~y) % 2
                state = np.where(fixed >= 0, x[fixed] ^ ((swaps - swaps[fixed]) % 2 == 1), self.inside ^ (swaps == 1))
                begins = np.flatnonzero(~np.append(self.inside, state[:-1]))
                if not len(begins):
                    self.held += values.to_pylist()
                    self.inside = bool(state[-1])
                    return
                if self.held or begins[0]:
                    self.held += values.slice(0, begins[0]).to_pylist()
                    self.inside = False
                    if self.held:
                        yield self.close()
                self.begun = True
                keep = begins[-1]  # the last record may go on in the next batch
                if keep > begins[0]:
                    yield out(self.key, WHOLE, *self._joined(values.slice(begins[0], keep - begins[0]), begins[:-1] - begins[0]))
                self.held = values.slice(keep).to_pylist()
                self.inside = bool(state[-1])

            def _joined(self, values, begins):
                _, offsets, data = values.buffers()
                wide = np.int64 if pa.types.is_large_string(values.type) else np.int32
                at = np.frombuffer(offsets, dtype=wide)[values.offset:values.offset + len(values) + 1].astype(np.int64)
                source = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
                glue = np.ones(len(values), dtype=bool)  # a newline behind every line that does not end its record
                glue[np.append(begins[1:], len(values)) - 1] = False
                ends = at[1:] - at[0] + np.cumsum(glue)
                text = np.zeros(int(ends[-1]), dtype=np.uint8)
                other = np.ones(len(text), dtype=bool)
                other[ends[glue] - 1] = False
                text[other], text[~other] = source, 10
                cut = np.append(0, ends[np.append(begins[1:], len(values)) - 1])
                records = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
                return self.flags(records), records

        now = None
        for b in batches:
            file, block, x, y, opened = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5))
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(file)]):
                if high == low:
                    continue
                key = (int(file[low]), int(block[low]))
                if now is None or key != now.key:
                    if now is not None and now.held:
                        yield now.close()
                    now = Split(key, bool(opened[low]))
                yield from now.add(b.column(2).slice(low, high - low), x[low:high].astype(bool), y[low:high].astype(bool))
        if now is not None and now.held:
            yield now.close()

    starts = opened.withColumn("open", F.lit(True))
    if opened.count() <= BROADCAST_SPLITS:  # keeps the lines in place
        placed = lines.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        placed = (lines.withColumn("place", F.monotonically_increasing_id()).join(starts, ["file", "block"], "left")
                  .repartition("file", "block").sortWithinPartitions("file", "block", "place"))
    return placed.select("file", "block", "value", "outside", "inside", F.coalesce("open", F.lit(False)).alias("open")).mapInArrow(
        build, _PIECE)


def records(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """``record``: every record that is not empty, without each file's header."""
    lines = _lines(spark, paths, sep)
    pieces = _pieces(lines, _inside_at_start(_split_maps(lines)))
    order = Window.partitionBy("file").orderBy("block", "kind")
    parts = (pieces.where(F.col("kind") != WHOLE)
             .withColumn("of", F.count(F.when(F.col("kind") == BEGIN, 1)).over(order))
             .groupBy("file", "of").agg(
                 F.sort_array(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"), F.max("first").alias("first"))
             .select("first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "record")
    text = F.regexp_replace("record", "\\r\\z", "")
    return whole.union(parts).where(~F.col("first")).select(text.alias("record")).where("record <> ''")
