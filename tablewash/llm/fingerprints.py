"""Document fingerprints: bottom-k sketches of word-shingle hashes, native.

A text's shingles are its runs of ``SHINGLE`` words (a shorter text is one
shingle, a text without words has none); its sketch is the ``K`` smallest of
their distinct 64-bit hashes. Sketches merge (``merge``): that of a whole is the
merge of its parts' sketches. From sketches follow estimates of resemblance,
containment and the number of distinct shingles, exact while a set has at most
``K`` shingles. Equal texts have equal sketches; null counts as empty; two texts
without words resemble each other fully, one without words and one with not at all.

``edit_report`` pairs every document with the next one in descending order of id
without a global sort: quantiles of the ids cut them into ordered buckets, a
window inside each bucket finds the next row, and only each bucket's last row
looks up the first row of the following bucket. Rows with the same id follow each
other in the order of their text's hash; rows without id come last; a single row
is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
K = 128
_BLANKS = " \t\n\u000b\f\r"
BUCKET_ROWS = 1_000
MAX_BUCKETS = 1 << 13  # more rows only make the buckets larger


def sketch(text: Column, shingle: int = SHINGLE, k: int = K) -> Column:
    """Sorted array of the k smallest shingle hashes."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))

    def of(h):
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0))),
                           lambda i: F.xxhash64(*[F.get(h, i + j if j else i) for j in range(shingle)]))
        return F.slice(F.sort_array(F.array_distinct(runs)), 1, k)

    # the words' hashes are bound once, by the outer transform
    hashed = F.transform(F.split(trimmed, f"[{_BLANKS}]+"), lambda w: F.xxhash64(w))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.array(hashed), of)[0])


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of both."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    all_ = F.size(merge(a, b, k))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    kth = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    n = distinct_shingles(a, k)
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / n))


def to_text(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash, in the sketch's order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    return docs.select(id_col, sketch(F.col(text_col), k=k).alias("sketch"))


def _bucket(key: Column, edges: list[int]) -> Column:
    """Number of edges that are at most the key, by binary search."""
    if not edges:
        return F.lit(0)
    list_ = F.lit(edges).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(len(edges).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(list_, lo + s - 1) <= key, lo + s).otherwise(lo))


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """The frame with a column ``next``: a struct of ``columns`` of the next row in
    descending order of id, after the last row the first."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keyed = docs.withColumn("__key", key)
    ids = docs.select(key.alias("__key"))
    n = ids.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    shares = [i / buckets for i in range(1, buckets)]
    edges = []
    if shares:
        got = ids.agg(F.percentile_approx("__key", shares, max(10_000, 20 * buckets))).first()[0]
        edges = sorted(set(got or []))
    ends = {r["b"]: (r["lo"], r["hi"]) for r in
            ids.groupBy(_bucket(F.col("__key"), edges).alias("b"))
            .agg(F.min("__key").alias("lo"), F.max("__key").alias("hi")).collect()}
    keyed = keyed.withColumn("__bucket", _bucket(F.col("__key"), edges))
    order = [F.col("__key").desc(), F.col(tie).asc_nulls_first()]
    value = F.struct(*columns)
    inside = (keyed.withColumn("next", F.lead(value).over(W.partitionBy("__bucket").orderBy(*order)))
              .where(F.col("next").isNotNull()).drop("__key", "__bucket"))
    if not ends:
        return keyed.select(*docs.columns, F.lit(None).cast(_struct_type(docs, columns)).alias("next")).limit(0)
    # one row of each bucket: its last, and the first of the bucket below it (of the lowest: the highest)
    at = sorted(ends)
    spark = docs.sparkSession
    follow = spark.createDataFrame(
        [(b, ends[b][0], at[i - 1], ends[at[i - 1]][1]) for i, b in enumerate(at)],
        "__b int, __lo long, __below int, __hi long")
    first = (keyed.join(F.broadcast(follow.select(F.col("__hi").alias("__key"), F.col("__b").alias("__of"))), "__key")
             .withColumn("__n", F.row_number().over(W.partitionBy("__of").orderBy(*order))).where("__n = 1")
             .select("__of", value.alias("next")))
    reverse = [F.col("__key").asc(), F.col(tie).desc_nulls_last()]
    last = (keyed.join(F.broadcast(follow.select(F.col("__lo").alias("__key"), F.col("__b").alias("__of"))), "__key")
            .withColumn("__n", F.row_number().over(W.partitionBy("__of").orderBy(*reverse))).where("__n = 1"))
    return inside.unionByName(last.join(first, "__of").select(*docs.columns, "next"))


def _struct_type(docs: DataFrame, columns: list[str]) -> str:
    kinds = dict(docs.dtypes)
    return "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in columns) + ">"


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third replaced by
    the beginning of the next document), and their estimated resemblances."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).withColumn(
        "__sketch", sketch(F.col("__text"), k=k)).withColumn("__tie", F.xxhash64("__text"))
    pairs = with_next(own, "__id", ["__text", "__sketch"], "__tie")
    n = F.length("__text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), n - third),
                      F.substring(F.col("next")["__text"], F.lit(1), third))
    out = (pairs.select("__id", n.cast("long").alias("n_chars"), edited.alias("__edited"), "__sketch",
                        F.col("next")["__sketch"].alias("__next"))
           .withColumn("__edited_sketch", sketch(F.col("__edited"), k=k)))
    return out.select(
        F.col("__id").alias(id_col), "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
        to_text(F.col("__sketch")).alias("fingerprint"), to_text(F.col("__edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("__sketch"), F.col("__edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("__sketch"), F.col("__next"), k).alias("near_next"),
        distinct_shingles(F.col("__sketch"), k).alias("n_shingles"))
