"""Benchmark decontamination: documents that hold a benchmark item, native.

Every item is compared with the windows of its own number of words in every
document. A window that is similar enough holds a certain number of places whose
shingle (``SHINGLE`` words) occurs in the item, wherever there; so the places of shared
shingles are collected per document and item, and sliding counts over them give all windows
that can be similar enough, moved and reordered passages included. These windows are
fingerprinted: a SimHash of 64 bits is cut into ``RADIUS + 1`` blocks; fingerprints
within ``RADIUS`` bits agree in at least one block, so an equi-join on window size,
block and its value finds them all. Candidates within the radius are verified by the
exact weighted similarity of their shingles (each weighs as often as it occurs).
At the threshold itself the fingerprints of two texts differ by 10 bits on average;
beyond ``RADIUS`` lies fewer than one in a million such pairs.

Words are separated by white space and lower-cased. An item with fewer words than a
shingle is a single shingle. A document shorter than the item is one window.
Nulls and texts or items without words match nothing. Items are broadcast up to
``BROADCAST_SHINGLES`` shingles, the documents' windows up to ``BROADCAST_WINDOWS``,
counted first; beyond that the same joins shuffle. Rows that share an id are looked at
separately and reported under that id. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch

SHINGLE = 5
PERCENT = 80
RADIUS = 26
BROADCAST_SHINGLES = 1_000_000
BROADCAST_WINDOWS = 2_000_000  # of 12 bytes
_BLANKS = " \t\n\u000b\f\r"


def _word_hashes(text: Column) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(trimmed, f"[{_BLANKS}]+"), lambda w: F.xxhash64(w)))


def _shingles(h: Column) -> Column:
    """Hash of each run of SHINGLE words; of a shorter sequence the whole."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get(h, i + j if j else i) for j in range(SHINGLE)]))
    return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(runs)


def _blocks() -> list[tuple[int, int]]:
    """(first bit, number of bits) of RADIUS + 1 blocks."""
    n = RADIUS + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def _majority(s: Column, lanes: int) -> Column:
    """64 majority bits, by ``lanes`` counters of 64 / lanes bits that share a long."""
    step = 64 // lanes
    mask = sum(1 << (i * step) for i in range(lanes))
    mask -= (mask >> 63) << 64

    def bits(j: int) -> Column:
        sums = F.aggregate(s, F.lit(0).cast("long"),
                           lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask)))
        out = F.lit(0).cast("long")
        for lane in range(lanes):
            n = F.shiftrightunsigned(sums, lane * step).bitwiseAND(F.lit((1 << step) - 1))
            out = out.bitwiseOR(F.when(2 * n > F.size(s), F.shiftleft(F.lit(1).cast("long"), lane * step + j))
                                .otherwise(F.lit(0).cast("long")))
        return out

    parts = [bits(j) for j in range(step)]
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])]
    return parts[0]


def simhash(s: Column) -> Column:
    """64 majority bits of the shingle hashes. Short lists take narrow counters, which
    need fewer passes; the bits are the same. Half of a counter stays free, for the sign."""
    return (F.when(F.size(s) < 1 << 7, _majority(s, 8)).when(F.size(s) < 1 << 15, _majority(s, 4))
            .otherwise(_majority(s, 2)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles."""
    def n(list_, x):
        return F.size(F.filter(list_, lambda y: y == x))

    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(n(a, x), n(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def items(benchmark: DataFrame) -> DataFrame:
    """``item_id, words, shingles, fp`` of every item with words."""
    out = (benchmark.select("item_id", _word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
           .select("item_id", F.size("h").alias("words"), _shingles(F.col("h")).alias("shingles")))
    return out.withColumn("fp", simhash(F.col("shingles")))


def _begins(hits: DataFrame, percent: int) -> DataFrame:
    """``doc_id, row, words, at`` of the windows that hold enough places shared with an item."""
    mine = F.greatest(F.least("words", "n") - (SHINGLE - 1), F.lit(1))
    theirs = F.greatest(F.col("words") - (SHINGLE - 1), F.lit(1))
    need = F.ceil(percent * (mine + theirs) / (100 + percent)).cast("int")
    enough = (hits.groupBy("doc_id", "row", "n", "item_id", "words").agg(F.collect_set("p").alias("at"))
              .withColumn("need", need).where(F.size("at") >= F.col("need"))
              .select("doc_id", "row", "words", "need", (mine - 1).alias("reach"), F.greatest(F.col("n") - F.col("words"), F.lit(0))
                      .alias("last"), F.sort_array("at").alias("at")))
    # any `need` places in a row that fit into a window, and the begins of the windows around them
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(
        F.greatest(F.get("at", i + F.col("need") - 1) - F.col("reach"), F.lit(0)).alias("low"),
        F.least(F.get("at", i), F.col("last")).alias("high"))), lambda w: w["low"] <= w["high"])
    begins = F.array_distinct(F.flatten(F.transform(spans, lambda w: F.sequence(w["low"], w["high"]))))
    return enough.select("doc_id", "row", "words", F.explode(begins).alias("at")).distinct()


def _windows(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """``doc_id, row`` (hash of the text), ``item_id, at, similarity`` of the
    windows at or above the threshold. ``docs``: columns doc_id and text."""
    scratch = Scratch(docs.sparkSession, "windows")
    all_items = items(benchmark)
    size = all_items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_SHINGLES else (lambda df: df)
    shingles = all_items.select("item_id", "words", F.explode("shingles").alias("s")).distinct()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("row"), _word_hashes(F.col("text")).alias("h"))
    # items of fewer words than a shingle meet the runs of just as many words
    short = [r[0] for r in all_items.where(F.col("words") < SHINGLE).select("words").distinct().collect()]
    runs = hashed.select("doc_id", "row", F.size("h").alias("n"), F.posexplode(_shingles(F.col("h"))).alias("p", "s"))
    for k in short:
        few = F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.xxhash64(
            *[F.get(F.col("h"), i + j) if j < k else F.lit(None).cast("long") for j in range(SHINGLE)]))
        runs = runs.unionByName(hashed.where(F.size("h") >= k).select(
            "doc_id", "row", F.size("h").alias("n"), F.posexplode(few).alias("p", "s")))
    begins = scratch.keep(_begins(runs.join(small(shingles), "s"), percent), "begins")
    near = begins.groupBy("doc_id", "row").agg(F.collect_set(F.struct("words", "at")).alias("near"))
    # beyond the bound the texts are shuffled
    near = F.broadcast(near) if begins.count() <= BROADCAST_WINDOWS else near
    back = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("r"), "text")
    found = back.join(near, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")))

    def cut(h, whole):
        return F.transform("near", lambda w: F.struct(w["words"].alias("words"), w["at"].alias("at"), F.when(
            F.least(w["words"], F.size(h)) >= SHINGLE,
            F.slice(whole, w["at"] + 1, F.least(w["words"], F.size(h)) - (SHINGLE - 1)))
            .otherwise(_shingles(F.slice(h, w["at"] + 1, w["words"]))).alias("mine")))

    # hashes of the words and shingles are bound once for each text, by the outer transforms
    cuts = F.flatten(F.transform(F.array(_word_hashes(F.col("text"))), lambda h: F.flatten(
        F.transform(F.array(_shingles(h)), lambda whole: cut(h, whole)))))
    windows = found.select("doc_id", "row", F.explode(cuts).alias("w")).select("doc_id", "row", "w.words", "w.at", "w.mine")
    windows = windows.withColumn("fp_mine", simhash(F.col("mine")))

    def keys(fp: str) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND(
            F.lit((1 << bits) - 1).cast("long")).alias("value")) for i, (at, bits) in enumerate(_blocks())])

    mine = windows.select("*", F.explode(keys("fp_mine")).alias("key")).select("*", "key.block", "key.value").drop("key")
    theirs = (all_items.select("*", F.explode(keys("fp")).alias("key"))
              .select("item_id", "words", "shingles", "fp", "key.block", "key.value"))
    close = (mine.join(small(theirs), ["words", "block", "value"])
             .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_mine"))) <= RADIUS)
             # of the blocks that agree only the first one counts
             .where(F.col("block") == _first_block("fp", "fp_mine"))
             .select("doc_id", "row", "item_id", "at",
                     similarity(F.col("mine"), F.col("shingles")).alias("similarity")))
    return close.where(F.col("similarity") * 100 >= percent)


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, similarity`` and first word of the most similar window of
    each document and item at or above the threshold."""
    best = F.max(F.struct(F.col("similarity"), (-F.col("at")).alias("at")))
    return (_windows(docs.select("doc_id", "text"), benchmark, percent).groupBy("doc_id", "item_id").agg(best.alias("best"))
            .select("doc_id", "item_id", F.col("best.similarity").alias("similarity"),
                    (-F.col("best.at")).cast("long").alias("first_word")))


def _first_block(a: str, b: str) -> Column:
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.coalesce(*[F.when(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) == 0, F.lit(i))
                        for i, (at, bits) in enumerate(_blocks())])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Every row is
    judged by its own text, whatever id it has."""
    found = _windows(docs.select("doc_id", "text"), benchmark, percent).select("doc_id", "row").distinct()
    own = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("r"))
    left = own.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")), "left_anti")
    return left.select("whole.*")
