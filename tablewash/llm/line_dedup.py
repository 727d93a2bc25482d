"""Line dedup: later copies of repeated line runs are deleted, native.

The non-blank lines of every document, in order, are a sequence of line ids
(128-bit hashes). Distributed prefix doubling names the suffixes of all sequences:
the name of the first 2**k lines of a suffix is made of the names of its first and
its second 2**(k-1) lines. Suffixes with the same name are one interval of the
suffix array whose longest common prefix is 2**k lines or more; a suffix that is
alone with its name is dropped from all further rounds. Two overlapping names
give the intervals of exactly ``min_lines`` lines. In each interval the suffix at
the smallest (id, place) is the first copy; the lines that another one shares
with it are deleted. A maximal repeated run is the union of such overlapping
intervals, so all of every later copy goes. A line of ``LONG_WORDS`` words or more is
a run by itself: in the intervals of single lines its later copies are deleted too,
whatever stands around them; shorter stock lines stay. ``depth`` goes on doubling and
gives the largest 2**k up to which a document's later copies reach.

Blank lines (blanks, tabs, returns only) take no part and stay, unless the
document has lost all its other lines: then it has no text left. Null and empty
texts have no lines. A run may repeat inside its own document. Rows with the same
id and text are one document to the operator; each of them gets its result. Rows
without id come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch

MIN_LINES = 2
LONG_WORDS = 50
_KEY = ["k1", "k2"]


def _place():
    return F.struct("k1", "k2", "i")



def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"k1": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
                             "k2": F.xxhash64(F.col(text_col))})


def _not_blank(line):
    return F.btrim(line, F.lit(" \t\r")) != ""


def _long(line):
    words = F.size(F.split(F.btrim(line, F.lit(" \t\u000b\f\r")), "[ \t\u000b\f\r]+"))
    return F.when(F.length(line) >= 2 * LONG_WORDS - 1, words >= LONG_WORDS).otherwise(False)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k1, k2, i`` (place among the non-blank lines), ``line`` (place among all), ``a, b`` (id),
    ``long`` (whether it is a run by itself)."""
    all_ = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
                       lambda s, n: F.struct(n.alias("line"), s.alias("s")))
    ids = F.transform(F.filter(all_, lambda x: _not_blank(x["s"])), lambda x: F.struct(
        x["line"].alias("line"), F.xxhash64(x["s"]).alias("a"), F.xxhash64(x["s"], F.lit(1)).alias("b"),
        _long(x["s"]).alias("long")))
    return (_keyed(docs, id_col, text_col).select(*_KEY, F.posexplode(ids).alias("i", "x"))
            .select(*_KEY, "i", "x.line", "x.a", "x.b", "x.long"))


def _shared(named: DataFrame, scratch: Scratch, name: str, *more: str) -> DataFrame:
    """The suffixes that share their name, and whether they are a later copy. The
    intervals are written first: joined to a table, a name of very many suffixes
    can be split among tasks."""
    intervals = scratch.keep(named.groupBy("a", "b").agg(F.min(_place()).alias("lo"), F.max(_place()).alias("hi"))
                             .where("lo <> hi").select("a", "b", "lo"), f"{name}-intervals")
    return scratch.keep(named.join(intervals, ["a", "b"])
                        .select(*_KEY, "i", "line", "a", "b", *more, (_place() != F.col("lo")).alias("later")), name)


def _doubled(shared: DataFrame, step: int) -> DataFrame:
    """Names of the runs made of a suffix's run and the one ``step`` lines on."""
    at = W.partitionBy(*_KEY).orderBy("i").rangeBetween(step, step)
    next_ = [F.first(c).over(at).alias(f"n{c}") for c in ("a", "b")]
    return (shared.select(*_KEY, "i", "line", "a", "b", *next_).where("na IS NOT NULL")
            .select(*_KEY, "i", "line", F.xxhash64("a", "b", "na", "nb").alias("a"),
                    F.xxhash64("b", "a", "nb", "na", F.lit(1)).alias("b")))


def deletions(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, id_col: str = "doc_id",
              text_col: str = "text", depth: bool = False) -> DataFrame:
    """``k1, k2, gone`` (numbers of the deleted lines), ``n_runs`` and, if asked for, ``depth``."""
    named = lines(docs, id_col, text_col).dropDuplicates([*_KEY, "i"])
    first = shared = _shared(named, scratch, "level-0", "long")
    size, level = 1, 0
    while 2 * size <= min_lines:
        level += 1
        shared = _shared(_doubled(shared, size), scratch, f"level-{level}")
        size *= 2
    runs = shared
    if size < min_lines:  # two overlapping names
        runs = _shared(_doubled(shared, min_lines - size), scratch, "runs")
    alone = (F.col("later") & F.col("long")).alias("alone")
    marked = first.select(*_KEY, "i", "line", alone).join(
        runs.select(*_KEY, "i", "later"), [*_KEY, "i"], "left") if min_lines > 1 else first.withColumn("alone", alone)
    covered = F.max(F.coalesce("later", F.lit(False))).over(
        W.partitionBy(*_KEY).orderBy("i").rangeBetween(1 - min_lines, 0))
    cut = (marked.withColumn("gone", covered | F.col("alone")).where("gone")
           .withColumn("start", F.coalesce(F.col("i") - F.lag("i").over(W.partitionBy(*_KEY).orderBy("i")) > 1,
                                           F.lit(True)).cast("int"))
           .groupBy(*_KEY).agg(F.sort_array(F.collect_list("line")).alias("gone"), F.sum("start").alias("n_runs")))
    if not depth:
        return cut
    reach = (runs.where("later").groupBy(*_KEY).agg(F.lit(min_lines).alias("depth"))
             .union(first.where("later AND long").groupBy(*_KEY).agg(F.lit(1).alias("depth"))))
    while shared.where("later").limit(1).count():
        level += 1
        shared = _shared(_doubled(shared, size), scratch, f"level-{level}")
        size *= 2
        if size >= min_lines:
            reach = reach.union(shared.where("later").groupBy(*_KEY).agg(F.lit(size).alias("depth")))
    return cut.join(reach.groupBy(*_KEY).agg(F.max("depth").alias("depth")), _KEY, "left")


def _without(docs: DataFrame, cut: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with columns ``gone, n_runs`` and ``left`` (the text that stays, null if none of its lines)."""
    keyed = _keyed(docs, id_col, text_col).join(cut, _KEY, "left")
    all_ = F.split(F.col(text_col), "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("gone"))
    rest = F.transform(keep, lambda n: F.get(all_, n))
    left = F.when(F.exists(rest, _not_blank), F.array_join(rest, "\n"))
    return keyed.withColumn("left", F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(left))


def remove_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The documents without later copies; one whose lines are all deleted goes.
    ``n_chars``, if there, is the length of the text that stays."""
    scratch = Scratch(docs.sparkSession, "lines")
    # whatever other columns are called, they travel in one
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    cut = deletions(own.select("id", "text"), scratch, min_lines, "id", "text")
    out = _without(own, cut, "id", "text").where(F.col("gone").isNull() | F.col("left").isNotNull())
    new = {text_col: F.col("left")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("left")).cast(kind)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: its non-blank lines, deleted lines and runs, how far later
    copies reach (0: none), and the hash of the text that stays (null: none)."""
    scratch = Scratch(docs.sparkSession, "lines")
    own = docs.select(id_col, text_col)
    out = _without(own, deletions(own, scratch, min_lines, id_col, text_col, depth=True), id_col, text_col)
    all_ = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    return out.select(id_col, F.size(F.filter(all_, _not_blank)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
                      F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
                      F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
                      F.sha2("left", 256).alias("left_sha256"))


# The same by plain windows of two lines: a line goes if a window that covers it came before,
# or if it has 50 words and came before itself.
# The depth is found from windows of 2, 4, 8, ... lines (up to 64 here, enough for the tested tables).
ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, text, n - 1 AS line, string_split(text, chr(10))[n] AS s
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n)),
p AS (
  SELECT doc_id, line, s, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i
  FROM l WHERE trim(s, ' ' || chr(9) || chr(13)) <> ''),
w AS (
  SELECT doc_id, i, line, s, s || chr(10) || lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS r2,
    {longer}
  FROM p),
f2 AS (SELECT doc_id, i, r2 IS NOT NULL AND row_number() OVER (PARTITION BY r2 ORDER BY doc_id, i) > 1 AS later,
    row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AND len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) >= 50 AS alone,
    {later}
  FROM w),
c AS (
  SELECT p.doc_id, p.line, p.i, p.s, coalesce(b.later, FALSE) OR coalesce(a.later, FALSE) OR coalesce(b.alone, FALSE) AS gone
  FROM p LEFT JOIN f2 b ON b.doc_id = p.doc_id AND b.i = p.i LEFT JOIN f2 a ON a.doc_id = p.doc_id AND a.i = p.i - 1),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted,
    count(*) FILTER (gone AND NOT before) AS n_runs, count(*) FILTER (NOT gone) AS n_left
  FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS before FROM c) GROUP BY 1),
d AS (SELECT doc_id, greatest({depth}) AS depth FROM f2 GROUP BY 1),
t AS (
  SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) AS rest
  FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.line = l.line WHERE NOT coalesce(c.gone, FALSE) GROUP BY 1)
SELECT x.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_deleted, 0) AS n_deleted,
  coalesce(g.n_runs, 0) AS n_runs, CAST(coalesce(d.depth, 0) AS BIGINT) AS depth,
  CASE WHEN coalesce(g.n_deleted, 0) = 0 THEN sha256(x.text) WHEN g.n_left > 0 THEN sha256(t.rest) END AS left_sha256
FROM documents x LEFT JOIN g ON g.doc_id = x.doc_id LEFT JOIN d ON d.doc_id = x.doc_id LEFT JOIN t ON t.doc_id = x.doc_id
""".format(
    longer=",\n    ".join(
        f"CASE WHEN count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) = {k} "
        f"THEN string_agg(s, chr(10)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) END AS r{k}"
        for k in (4, 8, 16, 32, 64)),
    later=",\n    ".join(
        f"r{k} IS NOT NULL AND row_number() OVER (PARTITION BY r{k} ORDER BY doc_id, i) > 1 AS later{k}"
        for k in (4, 8, 16, 32, 64)),
    depth=", ".join(["max(CASE WHEN alone THEN 1 ELSE 0 END)", "max(CASE WHEN later THEN 2 ELSE 0 END)"]
                    + [f"max(CASE WHEN later{k} THEN {k} ELSE 0 END)" for k in (4, 8, 16, 32, 64)]))
