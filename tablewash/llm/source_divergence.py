"""Source divergence audit: which terms set a source apart from its language, and
how far the sources of a language lie from each other.

Terms are runs of ASCII letters and code points from 128 on, A-Z lower-cased. Each
task counts the terms of a portion of texts on their bytes, in length buckets:

* up to 8 bytes are packed into one uint64, up to 16 into two, so that the order of
  the numbers is the order of the bytes; a bucket holds the terms of as many 16-bit
  digits, and is ordered by one radix pass a digit (numpy sorts 16-bit integers by
  radix), after one pass over the groups;
* longer terms lie in byte matrices, one for each power of two of their length, that
  are sorted by bytes.

In sorted order a term of a group is one run: its length is the count, the changes of
document inside it the number of documents. Spark sums the runs of all portions by
(language, source, term), and keeps the terms that enough documents of the language
hold. Shares are integers (decimals where 64 bits could overflow), so all sums are
exact in any order.

Distances of all pairs of sources are summed from blocks of terms: a block holds one
row of shares per source and sends one partial sum per pair, so pairs are never
expanded over terms between tasks.

Nulls in text, language and source count as ''. Texts without terms still give
their group; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch

PORTION = 1 << 23  # bytes of text counted at a time
BLOCK_ROWS = 50_000  # counts of kept terms per block
CELLS = 1 << 20  # shares that a block compares at a time
SCALE = 1_000_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
# Of a word's eight bytes, those that a term of 0 to 8 bytes fills.
_FILLED = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], dtype=np.uint64)


def _digits(word: np.ndarray, n: int) -> list[np.ndarray]:
    """The n highest 16-bit digits, lowest first."""
    return [(word >> np.uint64(64 - 16 * k)).astype(np.uint16) for k in range(n, 0, -1)]


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """The stable order by 16-bit digits, given from the lowest to the highest."""
    order = None
    for d in digits:
        step = np.argsort(d if order is None else d[order], kind="stable")
        order = step if order is None else order[step]
    return order


def _strings(rows: np.ndarray) -> pa.Array:
    """Zero-padded rows of bytes as strings (no term holds a zero byte)."""
    ends = np.append(0, np.cumsum((rows != 0).sum(axis=1)))
    flat = rows.reshape(-1)
    return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(ends.astype(np.int64)),
                                            pa.py_buffer(flat[flat != 0])).cast(pa.string())


def _runs(columns: list[np.ndarray], group: np.ndarray, doc: np.ndarray):
    """Of sorted rows: the places where a run of equal columns and group begins, the
    length of each run, and its number of documents."""
    new = group[1:] != group[:-1]
    for c in columns:
        new = new | (c[1:] != c[:-1])
    other = np.append(True, new | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(np.append(True, new))
    return first, np.diff(np.append(first, len(group))), np.add.reduceat(other, first, dtype=np.int64)


def _group_digits(group: np.ndarray) -> list[np.ndarray]:
    low = [(group & 0xFFFF).astype(np.uint16)]
    return low + [(group >> 16).astype(np.uint16)] if len(group) and int(group.max()) > 0xFFFF else low


def count_terms(text: np.ndarray, ends: np.ndarray, group: np.ndarray):
    """Of texts laid end to end: tuples of arrays (terms, groups, counts, documents),
    one for each length bucket. ``ends``: the end of each text; ``group``: its group."""
    size_all = len(text)
    b = np.zeros(size_all + 16, dtype=np.uint8)
    b[:size_all] = _LOWER[text]
    inside = _IN_TERM[b]
    cut = np.zeros(size_all + 1, dtype=bool)
    cut[0] = True
    cut[ends] = True
    before = np.append(False, inside[:size_all - 1]) if size_all else inside[:0]
    start = np.flatnonzero(inside[:size_all] & (~before | cut[:size_all]))
    stop = np.flatnonzero(inside[:size_all] & (~inside[1:size_all + 1] | cut[1:])) + 1
    size = stop - start
    doc = np.searchsorted(ends, start, side="right")
    width = np.minimum((size + 1) // 2, 9).astype(np.uint8)  # digits; 9: a long term
    by_width = np.argsort(width, kind="stable")
    bound = np.searchsorted(width[by_width], np.arange(1, 11))
    word = np.ndarray(size_all + 9, dtype=">u8", buffer=b, strides=(1,)) if size_all else None
    for n in range(1, 9):
        at = by_width[bound[n - 1]:bound[n]]
        if not len(at):
            continue
        s, k, d = start[at], size[at], doc[at]
        g = group[d]
        words = [word[s].astype(np.uint64) & _FILLED[np.minimum(k, 8)]]
        if n > 4:
            words.append(word[s + 8].astype(np.uint64) & _FILLED[k - 8])
        digits = [x for w, m in reversed(list(zip(words, (min(n, 4), n - 4)))) for x in _digits(w, m)]
        order = radix_order(_group_digits(g) + digits)
        words, g, d = [w[order] for w in words], g[order], d[order]
        first, counts, docs = _runs(words, g, d)
        rows = np.stack([w[first] for w in words], axis=1).astype(">u8").view(np.uint8)
        yield _strings(rows.reshape(len(first), 8 * len(words))), g[first], counts, docs
    long = by_width[bound[8]:]
    exponent = np.ceil(np.log2(np.maximum(size[long], 1))).astype(np.int64)
    for e in np.unique(exponent):
        at = long[exponent == e]
        at = at[radix_order(_group_digits(group[doc[at]]))]
        s, k, d = start[at], size[at], doc[at]
        rows = np.zeros((len(at), 1 << int(e)), dtype=np.uint8)
        if e <= 10:
            place = np.arange(1 << int(e))
            fill = place < k[:, None]
            rows[fill] = b[(s[:, None] + place)[fill]]
        else:
            for i, (x, y) in enumerate(zip(s, k)):
                rows[i, :y] = b[x:x + y]
        key = rows.view(f"S{1 << int(e)}").reshape(-1)
        order = np.argsort(key, kind="stable")
        first, counts, docs = _runs([key[order]], group[d][order], d[order])
        yield _strings(rows[order[first]]), group[d][order[first]], counts, docs


def _pieces(text: np.ndarray):
    """A text longer than a portion, cut between terms."""
    at = 0
    while at < len(text):
        end = min(at + PORTION, len(text))
        while end < len(text):
            out = np.flatnonzero(~_IN_TERM[text[end:end + PORTION]])
            end = end + int(out[0]) if len(out) else min(end + PORTION, len(text))
            if len(out):
                break
        yield text[at:end]
        at = end


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places between its rows."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8), at


def _count(batches):
    """Batches of (lang, source, text) to (lang, source, term, n, d); each group also
    has a row with the term '' and counts of 0."""
    names = ["lang", "source", "term", "n", "d"]

    def out(langs, sources, found):
        for terms, g, n, d in found:
            at = pa.array(g)
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms, pa.array(n, pa.int64()),
                                              pa.array(d, pa.int64())], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        number: dict = {}
        group = np.array([number.setdefault(p, len(number))
                          for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], dtype=np.int64)
        langs, sources = (pa.array([p[i] for p in number], pa.string()) for i in (0, 1))
        none = np.zeros(len(number), dtype=np.int64)
        yield from out(langs, sources, [(pa.array([""] * len(number), pa.string()), np.arange(len(number)), none, none)])
        data, at = _texts(b.column(2))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + PORTION, side="right")) - 1)
            text = data[at[i]:at[j]]
            if j == i + 1 and len(text) > PORTION:  # one document: a term counts it once, in the first piece that has it
                seen: set = set()
                for piece in _pieces(text):
                    for terms, g, n, d in count_terms(piece, np.array([len(piece)]), group[i:j]):
                        fresh = np.array([t not in seen for t in terms.to_pylist()], dtype=np.int64)
                        seen.update(terms.to_pylist())
                        yield from out(langs, sources, [(terms, g, n, fresh)])
            else:
                yield from out(langs, sources, count_terms(text, at[i + 1:j + 1] - at[i], group[i:j]))
            i = j


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents of every term in every
    group, and a row with the term '' for each group."""
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
                        for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return (own.mapInArrow(_count, "lang string, source string, term string, n long, d long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact; null without terms."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, _div(wide, (total + 2 * terms).cast("decimal(20,0)")) + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _block_sums(info: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial distances of a language's pairs of sources, over the terms of a block."""
    info = info.sort_values("source", ignore_index=True)
    names = info["source"].to_numpy(dtype=object)
    place, term = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if len(rows):
        place = np.searchsorted(names, rows["source"].to_numpy(dtype=object))
        term = pd.factorize(rows["term"])[0]
    share, none = rows["p"].to_numpy(dtype=np.int64), info["none"].fillna(0).to_numpy(dtype=np.int64)
    order = np.argsort(term, kind="stable")
    place, term, share = place[order], term[order], share[order]
    n, terms = len(names), int(term[-1]) + 1 if len(term) else 0
    total = np.zeros((n, n), dtype=np.int64)
    step = max(1, CELLS // max(n, 1))
    for low in range(0, terms, step):
        cut = slice(*np.searchsorted(term, [low, low + step]))
        p = np.repeat(none[:, None], min(step, terms - low), axis=1)
        p[place[cut], term[cut] - low] = share[cut]
        for i in range(n - 1):
            apart = p[i] - p[i + 1:]
            total[i, i + 1:] += (apart * apart // (p[i] + p[i + 1:])).sum(axis=1)
    a, b = np.triu_indices(n, 1)
    lang = info["lang"].iloc[0] if n else ""
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[b], "value": total[a, b]})


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source its distance to each
    other source of its language (part ``pair``), and the terms, at most ``top``, that it
    has in excess of the language (part ``term``). A language keeps the terms that at
    least ``min_docs`` of its documents hold."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    w = Window.partitionBy("lang", "term")
    kept = scratch.keep(
        term_counts(docs).withColumns({"total": F.sum("n").over(w), "docs": F.sum("d").over(w),
                                       "head": F.min("source").over(w)})
        .where(F.col("docs") >= F.when(F.col("term") == "", 0).otherwise(min_docs))
        .select("lang", "source", "term", "n", "total",
                ((F.col("term") != "") & (F.col("head") == F.col("source"))).cast("long").alias("head")), "kept")
    lang = Window.partitionBy("lang")
    info = scratch.keep(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("here"), F.sum("head").alias("heads"))
        .select("lang", "source", "here", F.sum("here").over(lang).alias("all"), F.sum("heads").over(lang).alias("terms"))
        .withColumn("none", _share(F.lit(0), F.col("here"), F.col("terms"))), "info")
    rows = kept.where("term <> ''").join(info, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("here"), F.col("terms")).alias("p"),
        _share(F.col("total"), F.col("all"), F.col("terms")).alias("q"))

    excess = rows.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), kept.count() // BLOCK_ROWS)
    dealt = info.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    halves = (dealt.select("lang", "block", "source", "none").groupBy("lang", "block")
              .cogroup(rows.select("lang", block.alias("block"), "source", "term", "p").groupBy("lang", "block"))
              .applyInPandas(_block_sums, "lang string, a string, b string, value long"))
    pairs = halves.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select(
        "lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                           F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    terms = excess.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(*out)
    return (pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
            .withColumn("rank", F.row_number().over(best)).select(*out).union(terms))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n, sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT AS total
          FROM c GROUP BY lang, term),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 2) // (s.total + 2 * v.v) AS p
      FROM size s JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT w.lang, w.term, 1 + 1000000000 * (w.n + 2) // (w.total + 2 * v.v) AS q FROM whole w JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
          FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
