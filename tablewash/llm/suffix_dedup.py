"""Suffix-array dedup: bytes covered by a 50-byte string of an earlier document.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id; strings are judged on the input. Three steps find
these strings without sorting every suffix of the corpus:

1. Cover. Anchors (``anchors.py``) are a cover of the suffixes: equal strings of
   LENGTH bytes hold an anchor at the same place, so shifted by the same distance
   below WIDTH both start at a sampled suffix. One anchor in CHUNK also cuts the text
   into chunks, each taken with the bytes that any string through its anchors
   reaches. A chunk that occurs in a smaller document is covered whole; only the
   first of equal chunks goes on, and of it only anchors that also occur in other
   chunks. This is where most copies end.
2. Suffix order. The strings around such anchors are dealt out by the anchor's
   gram, so equal strings meet, and are ordered by difference cover: of their
   suffixes at places 1 and 2 modulo 3 the triples of bytes are sorted and named,
   the names are taken as triples again (9 bytes, then 27), two names then cover
   LENGTH bytes; suffixes at places 0 are merged in by their byte and the name of the
   suffix after it. Neighbours in this order with equal prefixes are one string; all
   but those of its smallest document are covered. A gram of more than HOT_GRAM
   strings is not dealt to one task: its strings are counted by hash, with partial
   aggregation first.
3. The covered runs of each document are united.

Hashes of grams, chunks and strings have 64 bits. Texts are read whole as UTF-8,
null as empty; strings never cross documents. Rows that share an id are one
document with several texts and remove nothing from each other; rows without id
neither remove nor lose bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.anchors import (
    CHUNK,
    GRAM,
    LENGTH,
    WIDTH,
    anchors,
    gram_hashes,
    part_hashes,
    prefix_hashes,
)
from tablewash.llm.common import Scratch, portions, release
from tablewash.llm.shingles import mix

LEFT = WIDTH - 1  # bytes before an anchor that a string through it can reach
SPAN = LEFT + LENGTH  # bytes around an anchor: LEFT before its start, LENGTH from it on
DOCS_PER_PART = 1_250
HOT_GRAM = 20_000
PORTION = 10_000  # contexts that are ordered at a time


def _pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of unsigned numbers, each in so many bytes, one column after another."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]).tobytes()
                    for c, w in columns)


def _unpack(blocks: list[tuple[bytes, int]], widths: list[int]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for data, n in blocks:
        at = 0
        for i, w in enumerate(widths):
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, :w] = np.frombuffer(data, dtype=np.uint8, count=n * w, offset=at).reshape(n, w)
            out[i].append(wide.view("<u8").reshape(-1))
            at += n * w
    return [np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in out]


_NONE = np.uint64((1 << 64) - 1)
_CHUNK_WIDTHS = [8, 8, 5, 5]  # hash, document, start, end
_ANCHOR_WIDTHS = [6, 6, 8, 5]  # gram hash, chunk hash, document, place


class _Joined:
    """The texts of some documents in one buffer: of each text where it starts and
    ends, its document, and its offset in the document's texts."""

    def __init__(self, docs, texts):
        parts, ids, bases = [], [], []
        for doc, row in zip(docs, texts):
            base = 0
            for t in row:
                parts.append((t or "").encode("utf-8", "surrogatepass"))
                ids.append(doc)
                bases.append(base)
                base += len(parts[-1])
        size = np.array([len(x) for x in parts], dtype=np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.doc, self.base = np.array(ids, dtype=np.int64), np.array(bases, dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.text = np.repeat(np.arange(len(parts)), size)  # of each byte
        self.prefix = prefix_hashes(self.bytes)
        self.grams = gram_hashes(self.prefix, GRAM)
        # grams over the end of a text are never the smallest
        n = len(self.grams)
        self.grams[np.arange(GRAM, n + GRAM) > self.end[self.text[:n]]] = _NONE

    def anchors(self) -> np.ndarray:
        at = anchors(self.grams)
        at = at[self.grams[at] != _NONE]
        long_enough = self.end - self.start >= LENGTH
        return at[long_enough[self.text[at]]]

    def place(self, at: np.ndarray) -> np.ndarray:
        """Places in the documents of places in the buffer."""
        t = self.text[np.minimum(at, len(self.text) - 1)]
        return at - self.start[t] + self.base[t]


def _starts(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far before each anchor the strings start whose smallest gram, the first
    of equal ones, is the anchor's: from first to last."""
    pad = np.full(LEFT, _NONE, dtype=np.uint64)
    near = np.concatenate([pad, grams, pad])[at[:, None] + np.arange(2 * LEFT + 1)]
    own = near[:, LEFT:LEFT + 1]
    before, after = near[:, LEFT - 1::-1] <= own, near[:, LEFT + 1:] < own
    last = np.where(before.any(axis=1), before.argmax(axis=1), LEFT)
    free = np.where(after.any(axis=1), after.argmax(axis=1), LEFT)  # grams after it that are no smaller
    return LEFT - free, last


def _cover(parts: int):
    """Documents to packed chunks and anchors by part. In a batch only a chunk's
    smallest document goes on; the others are covered at once."""

    def run(batches):
        for batch in portions(batches, lambda b: b["texts"], 1 << 20):
            x = _Joined(batch["doc"], batch["texts"])
            place = x.anchors()
            if not len(place):
                continue
            h = x.grams[place]
            whole = x.start[x.end - x.start >= LENGTH]
            start = np.unique(np.append(whole, place[(h >> np.uint64(20)) % np.uint64(CHUNK) == 0]))
            t = x.text[start]
            lo = np.maximum(start - LEFT, x.start[t])
            hi = np.minimum(np.minimum(np.append(start[1:], len(x.bytes)), x.end[t]) + LENGTH - 1, x.end[t])
            c, doc = part_hashes(x.prefix, lo, hi), x.doc[t]
            own, whose = c[np.searchsorted(start, place, "right") - 1], x.doc[x.text[place]]
            shift = x.base[t] - x.start[t]
            lo, hi, place = lo + shift, hi + shift, x.place(place)
            order = np.lexsort((doc, c))
            c, doc, lo, hi = c[order], doc[order], lo[order], hi[order]
            new = np.append(True, c[1:] != c[:-1])
            least = doc[new][np.cumsum(new) - 1]
            first = doc == least
            out = [(int(batch["doc"].iloc[0]) % parts, 1, doc[~first], lo[~first], hi[~first])]
            # anchors of the first documents of their chunks only
            keep = least[np.searchsorted(c, own)] == whose
            h, own, whose, place = h[keep], own[keep], whose[keep], place[keep]
            rows = [(p, kind, len(a), b"", _pack([(a, 8), (x, 5), (y, 5)])) for p, kind, a, x, y in out if len(a)]
            part = ((c >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            c, doc, lo, hi, part = c[first], doc[first], lo[first], hi[first], part[first]
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in np.unique(part):
                x = slice(cut[p], cut[p + 1])
                rows.append((int(p), 0, cut[p + 1] - cut[p], _pack([(c[x], 8), (doc[x], 8), (lo[x], 5), (hi[x], 5)]), b""))
            # anchors' hashes are smallest ones, most of them low: mixed, else the first parts hold most
            part = ((mix(h) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((own, h, part))
            h, own, whose, place, part = h[order], own[order], whose[order], place[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            low = np.uint64((1 << 48) - 1)
            for p in np.unique(part):
                x = slice(cut[p], cut[p + 1])
                rows.append((int(p), 2, cut[p + 1] - cut[p], _pack(
                    [(h[x] & low, 6), (own[x] & low, 6), (whose[x], 8), (place[x], 5)]), b""))
            yield pd.DataFrame(rows, columns=["part", "kind", "n", "data", "gone"])

    return run


_FOUND = "kind int, doc long, lo long, hi long"


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: covered chunks (kind 1), and anchors that occur in different chunks (kind 2)."""
    out = []
    gone = [(g, n) for k, n, g in zip(pdf["kind"], pdf["n"], pdf["gone"]) if k == 1]
    doc, lo, hi = _unpack(gone, [8, 5, 5])
    out.append((1, doc, lo, hi))
    c, doc, lo, hi = _unpack([(d, n) for k, n, d in zip(pdf["kind"], pdf["n"], pdf["data"]) if k == 0], _CHUNK_WIDTHS)
    if len(c):
        doc = doc.view(np.int64)
        order = np.lexsort((doc, c))
        c, doc, lo, hi = c[order], doc[order], lo[order], hi[order]
        new = np.append(True, c[1:] != c[:-1])
        later = doc != doc[new][np.cumsum(new) - 1]
        out.append((1, doc[later], lo[later], hi[later]))
    h, c, doc, at = _unpack([(d, n) for k, n, d in zip(pdf["kind"], pdf["n"], pdf["data"]) if k == 2], _ANCHOR_WIDTHS)
    if len(h):
        doc = doc.view(np.int64)
        order = np.lexsort((doc, c, h))
        h, c, doc, at = h[order], c[order], doc[order], at[order]
        new_h = np.append(True, h[1:] != h[:-1])
        new = new_h | np.append(True, c[1:] != c[:-1])
        group = np.cumsum(new_h) - 1
        several = np.bincount(group, weights=new)[group] > 1
        least = doc == doc[new][np.cumsum(new) - 1]
        keep = several & least
        out.append((2, doc[keep], at[keep], at[keep]))
    return pd.concat([pd.DataFrame({"kind": k, "doc": d.astype(np.int64), "lo": x.astype(np.int64),
                                    "hi": y.astype(np.int64)}) for k, d, x, y in out], ignore_index=True)


_AROUND = "gram long, doc long, place long, first int, last int, bytes binary"


def _around(batches):
    """The bytes around each wanted anchor. ``first`` to ``last``: how far before it
    its strings start; each string belongs to the anchor of its smallest gram."""
    for batch in portions(batches, lambda b: b["texts"], 1 << 20):
        x = _Joined(batch["doc"], batch["texts"])
        at, k = [], 0
        for texts, wanted in zip(batch["texts"], batch["wanted"]):
            wanted = np.sort(np.asarray(wanted, dtype=np.int64))
            for _ in texts:
                low = x.base[k]
                mine = wanted[slice(*np.searchsorted(wanted, [low, low + x.end[k] - x.start[k]]))]
                at.append(mine - low + x.start[k])
                k += 1
        at = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
        if not len(at):
            continue
        t = x.text[at]
        first, last = _starts(x.grams, at)
        first, last = np.maximum(at + LENGTH - x.end[t], first), np.minimum(at - x.start[t], last)
        fine = first <= last
        at, t, first, last = at[fine], t[fine], first[fine], last[fine]
        wide = np.concatenate([np.zeros(LEFT, dtype=np.uint8), x.bytes, np.zeros(LENGTH, dtype=np.uint8)])
        around = wide[at[:, None] + np.arange(SPAN)].tobytes()
        yield pd.DataFrame({"gram": x.grams[at].view(np.int64), "doc": x.doc[t], "place": x.place(at),
                            "first": first.astype(np.int32), "last": last.astype(np.int32),
                            "bytes": [around[i:i + SPAN] for i in range(0, len(around), SPAN)]})


def _name(*columns: np.ndarray) -> np.ndarray:
    """Ranks of the tuples of names, in their order."""
    out = columns[0].astype(np.uint64)
    if len(columns) == 3 and all(c.size and int(c.max()) < 1 << 21 for c in columns):
        for c in columns[1:]:
            out = out << np.uint64(21) | c.astype(np.uint64)
        columns = columns[:1]
    for c in columns[1:]:
        _, out = np.unique(out, return_inverse=True)
        out = out.reshape(c.shape).astype(np.uint64) << np.uint64(24) | c.astype(np.uint64)
    return np.unique(out, return_inverse=True)[1].reshape(columns[0].shape)


def _later_strings(s: np.ndarray, of: np.ndarray, gram: np.ndarray, doc: np.ndarray, first: np.ndarray,
                   last: np.ndarray) -> np.ndarray:
    """For each context (of: its row of bytes in s) and each place of its LENGTH-byte
    strings, whether a smaller document has the same string, by difference-cover
    suffix order."""
    n = len(of)
    # names of 3, 9 and 27 bytes of the suffixes at places 1 and 2 modulo 3
    name = {r: s[:, r:SPAN - 2:3].astype(np.uint64) << np.uint64(16) | s[:, r + 1:SPAN - 1:3].astype(np.uint64) << np.uint64(8)
            | s[:, r + 2:SPAN:3].astype(np.uint64) for r in (1, 2)}
    width = 3
    while width < 27:
        step = width // 3
        cut = {r: [x[:, i * step:x.shape[1] - (2 - i) * step] for i in range(3)] for r, x in name.items()}
        both = _name(*[np.concatenate([cut[1][i], cut[2][i]], axis=1) for i in range(3)])
        name = {1: both[:, :cut[1][0].shape[1]], 2: both[:, cut[1][0].shape[1]:]}
        width *= 3
    at = lambda p: name[p % 3][:, (p - p % 3) // 3].astype(np.int64)
    out = np.zeros((n, LEFT + 1), dtype=bool)
    for p in range(LEFT + 1):
        back = LEFT - p  # the string starts so far before the anchor
        rows = np.flatnonzero((first <= back) & (back <= last))
        if len(rows) < 2:
            continue
        # LENGTH bytes from place p on: two overlapping names, and the byte they leave out
        if p % 3 == 0:
            keys = (s[:, p], at(p + 1), at(p + LENGTH - 27))
        elif p % 3 == 1:
            keys = (at(p), at(p + LENGTH - 28), s[:, p + LENGTH - 1])
        else:
            keys = (at(p), at(p + LENGTH - 27))
        keys = [k[of[rows]] for k in keys] + [gram[rows]]
        d = doc[rows]
        order = np.lexsort((d, *keys[::-1]))
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]  # neighbours with different prefixes
        d = d[order]
        out[rows[order], back] = d != d[new][np.cumsum(new) - 1]
    return out


_SPANS = "doc long, lo long, hi long"


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Covered strings of one part's contexts, some grams at a time."""
    pdf = pdf.sort_values("gram", kind="stable")
    gram = pdf["gram"].to_numpy()
    out, start = [], 0
    while start < len(pdf):
        end = int(np.searchsorted(gram, gram[min(start + PORTION, len(pdf)) - 1], "right"))
        part = pdf.iloc[start:end]
        of, different = pd.factorize(part["bytes"])  # equal contexts are named once
        s = np.frombuffer(b"".join(different), dtype=np.uint8).reshape(-1, SPAN)
        doc, place = part["doc"].to_numpy(), part["place"].to_numpy()
        later = _later_strings(s, of, gram[start:end], doc, part["first"].to_numpy(), part["last"].to_numpy())
        row, back = np.nonzero(later)
        out.append(_united(doc[row], place[row] - back, place[row] - back + LENGTH))
        start = end
    return pd.concat(out, ignore_index=True)


def _united(doc, lo, hi) -> pd.DataFrame:
    """Overlapping runs of each document in one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if len(doc):
        _, group = np.unique(doc, return_inverse=True)
        shift = group.astype(np.int64) * (int(hi.max()) + 1)
        reach = np.maximum.accumulate(hi + shift)
        new = np.append(True, lo[1:] + shift[1:] > reach[:-1])
        end = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
        doc, lo, hi = doc[new], lo[new], (reach - shift)[end]
    return pd.DataFrame({"doc": doc, "lo": lo, "hi": hi})


def _by_hash(contexts: DataFrame) -> DataFrame:
    """The same for strings of very frequent grams, by hash."""
    def strings(batches):
        for b in batches:
            out = []
            for gram, doc, place, first, last, x in zip(b["gram"], b["doc"], b["place"], b["first"], b["last"], b["bytes"]):
                h = gram_hashes(prefix_hashes(np.frombuffer(x, dtype=np.uint8)), LENGTH)
                h = np.append(h, part_hashes(prefix_hashes(np.frombuffer(x, dtype=np.uint8)), np.array([LEFT]),
                                             np.array([SPAN])))
                out += [(int(h[LEFT - o].astype(np.int64)) if o else int(h[-1].astype(np.int64)), doc, place - o)
                        for o in range(first, last + 1)]
            yield pd.DataFrame(out, columns=["h", "doc", "lo"])

    each = contexts.mapInPandas(strings, "h long, doc long, lo long")
    least = each.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return (each.join(least.select("h", "least"), "h").where("doc > least")
            .select("doc", "lo", (F.col("lo") + LENGTH).alias("hi")))


def covered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, lo, hi``: covered runs, not yet united, of documents ``doc, texts``."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // DOCS_PER_PART)
    found = scratch.keep(docs.mapInPandas(_cover(parts), "part int, kind int, n long, data binary, gone binary")
                         .groupBy("part").applyInPandas(_meet, _FOUND), "found")
    release(spark)
    wanted = found.where("kind = 2").groupBy("doc").agg(F.collect_set("lo").alias("wanted"))
    contexts = scratch.keep(docs.join(wanted, "doc").mapInPandas(_around, _AROUND), "contexts")
    release(spark)
    hot = contexts.groupBy("gram").count().where(F.col("count") > HOT_GRAM).select("gram")
    of = contexts.join(hot.withColumn("hot", F.lit(True)), "gram", "left")
    key = F.pmod(F.col("gram"), F.lit(parts)).cast("int")
    later = of.where("hot IS NULL").withColumn("part", key).groupBy("part").applyInPandas(
        lambda pdf: _order(pdf), _SPANS)
    spans = later.unionByName(_by_hash(of.where("hot")))
    out = scratch.keep(spans.unionByName(found.where("kind = 1").select("doc", "lo", "hi")), "spans")
    release(spark)
    scratch.drop("found", "contexts")
    return out


def _texts(row) -> list[tuple[int, np.ndarray]]:
    """(offset in the document, bytes) of each text of a document."""
    out, base = [], 0
    for t in row:
        b = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        out.append((base, b))
        base += len(b)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Of every row: ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for,
    the bytes ``kept``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = own.where("doc IS NOT NULL")
    repeated = named.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    if repeated:
        grouped = named.groupBy("doc").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    else:
        grouped = named.select("doc", F.array("text").alias("texts"))
    grouped = grouped.withColumn("doc", F.col("doc").cast("long"))
    spans = covered(grouped, scratch).groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def finish(batches):
        for batch in portions(batches, lambda b: b["texts"], 1 << 20):
            out = []
            for doc, texts, lows, highs in zip(batch["doc"], batch["texts"], batch["lo"], batch["hi"]):
                runs: list[list[int]] = []
                for lo, hi in () if lows is None else sorted(zip(lows.tolist(), highs.tolist())):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(hi, runs[-1][1])
                    else:
                        runs.append([lo, hi])
                for (base, b), text in zip(_texts(texts), texts):
                    keep, n = [], 0
                    at = base
                    for lo, hi in runs:
                        lo, hi = max(lo, base), min(hi, base + len(b))
                        if lo >= hi:
                            continue
                        keep.append(b[at - base:lo - base])
                        at, n = hi, n + 1
                    keep.append(b[at - base:])
                    kept = b"".join(x.tobytes() for x in keep)
                    out.append((doc, text or "", len(b), len(b) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            done = pd.DataFrame(out, columns=["doc", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield done.drop(columns=[] if with_text else ["kept"]) if repeated else \
                done.drop(columns=["text"] if with_text else ["text", "kept"])

    schema = "doc long, " + "text string, " * repeated + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" \
        + ", kept binary" * with_text
    done = grouped.join(spans, "doc", "left").mapInPandas(finish, schema)
    if repeated:
        done = own.select("doc", "text").join(done.withColumn("doc", F.col("doc").cast(kind)), ["doc", "text"]).drop("text")
    n = F.octet_length("text").cast("long")
    bytes_ = F.encode("text", "utf-8")
    nameless = own.where("doc IS NULL").select(
        "doc", n.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(bytes_, 256).alias("kept_sha256"), *[bytes_.alias("kept")] * with_text)
    return (done.unionByName(nameless).withColumn("doc", F.col("doc").cast(kind))
            .withColumnRenamed("doc", id_col))
