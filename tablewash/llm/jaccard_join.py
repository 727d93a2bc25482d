"""N-gram Jaccard join by vertical partitioning, and its linked groups.

A document is the set of hashes of its distinct word n-grams. Documents with
equal sets form one class, whose smallest id stands for it. The global order of
the n-gram hashes is cut into fragments, and fragments are compared on their own:

* Candidates. For two sets of similarity at least t the symmetric difference has at
  most D = (1 - t) / (1 + t) * (|x| + |y|) n-grams. Cut into m > D fragments, such
  sets agree in at least m - D fragments. D depends on the sizes, so sizes are cut
  into classes of ratio 1/t and a set takes part in the two joins of neighbouring
  classes. Each non-empty fragment's signature is a key. Only a set with m - D or
  more empty fragments could agree in nothing else; it is keyed by its first
  n-grams of the order too, as many as a pair of similarity t must share one of.
  So every such pair shares a key: no candidate is lost, and hardly any comes from
  single frequent n-grams.
* Families. A batch sends each of its keys once, with the document that has it and shares
  most keys in the batch, and names the others as members of that document's family; where
  keys of batches meet, their smallest document gets a family of the senders and of the
  members behind them with such a key (by 64 bits of the keys). So every candidate pair lies
  in some family, no list of a key's documents meets anywhere, and a batch's share of a
  hot key is one entry.
* Bitmaps. A bit that one set's bitmap has and the other's lacks stands for an n-gram that the
  other lacks, which bounds their overlap from above. Bitmaps grow with the sets, the wider of two
  is folded to the narrower, and only pairs that may be similar by them have their sets made,
  anew from the texts, and sent. No set is kept or moved for a candidate that the bitmaps rule out.
* Overlaps with pivots. Each document is compared with one pivot, of the family with which
  it shares most keys: the member that shares most keys in all. Sets are cut at fixed
  places of the global order; (pivot, fragment) tasks count the partial overlap of the pivot's
  fragment with those of at most ``BLOCK_DOCS`` members and send (pair, count), and Spark
  sums them per pair. Near copies of one text are linked to it by as many pairs as there
  are copies.
* Nearest components. In families whose members lie in several components, bitmaps of the
  sets are compared block by block; each component's document that looks most like one of
  another component is compared with that one, as with a pivot.
* The rest. Families whose members still lie in several components are compared
  wholly, but for pairs inside a component: the members outside the largest one with each
  other and with those of the largest whose sizes allow a link, block by block. First
  only bitmaps of the sets meet; documents that are
  left without a partner go. The sets of the rest follow, their overlaps
  counted fragment by fragment as products of incidence matrices. Only
  links that connect something not connected yet leave a task. No link between
  documents of different components is lost, and a family of copies is never expanded
  into its pairs.

Which pivot is taken affects the work alone, never the result. Nulls count as empty
texts; texts without words link with nothing. Rows that share an id are one document;
rows without id link with nothing and have no component. Inside, a set is named by a
64-bit hash; equal hashes count as equal.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch, portions, release
from tablewash.llm.components import components
from tablewash.llm.shingles import mix, shingles

DOCS_PER_PART = 2_000
FRAGMENT = 4096  # n-grams of the order that one product of incidence matrices covers
FRAGMENTS = 8  # of a set compared with its pivot, cut by the highest bits
BLOCK_DOCS, BLOCK_NGRAMS = 1024, 1_000_000  # of a family; more of either is cut into blocks
STRIP = 256  # bitmaps compared with a block at a time
BITS = 2048  # of a set's bitmap; wide ones have as many more as the set needs
BROADCAST_DOCS = 1_000_000  # ids (8 bytes) that a join may broadcast; beyond, it shuffles the texts
NO_ID = -(1 << 63)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def size_classes(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size classes; sets of the given similarity lie in the
    same or in neighbouring classes."""
    out = [1]
    while out[-1] < largest:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out)


def _fragments(low: int, top: int, percent: int) -> tuple[int, int]:
    """For sets of low to top n-grams: the most in which a pair differs, and the
    number of fragments, above it by more than the empty ones to be expected."""
    d = (100 - percent) * 2 * top // (100 + percent)
    m = d + 2
    for _ in range(3):
        m = d + 2 + math.ceil(1.5 * m * math.exp(-low / m))
    return d, m


def candidate_keys(s: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """Keys of which any two different sets of the given similarity share at least one."""
    j = int(np.searchsorted(classes, len(s), "right")) - 1
    out = []
    for low in (j - 1, j):
        if low < 0:
            continue
        d, m = _fragments(int(classes[low]), int(classes[low + 2]) - 1, percent)
        if not d:  # so small that only equal sets are similar enough
            continue
        of = mix(_C[3] * np.array([low + 1], dtype=np.uint64))
        at = (((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)  # s is in order
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        signature = np.add.reduceat(mix(s), first, dtype=np.uint64)
        out.append(mix(signature ^ mix(of + _C[0] * (at[first].astype(np.uint64) + np.uint64(1)))))
        if m - len(first) >= m - d:  # all fragments that agree may be empty ones
            prefix = len(s) - -(-percent * len(s) // 100) + 1
            out.append(mix(s[:prefix] + of * _C[1]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)


def _pack(keys: np.ndarray, docs: np.ndarray) -> bytes:
    """Low six bytes of the keys (the part holds the high ones), and the documents'
    ids in as many bytes as the largest takes; the first byte tells how many."""
    width = 8 if docs.min() < 0 else max(1, -(-int(docs.max()).bit_length() // 8))
    cut = [np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].tobytes()
           for x, w in ((keys, 6), (docs.view(np.uint64), width))]
    return bytes([width]) + b"".join(cut)


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    n, at, out = (len(data) - 1) // (6 + width), 1, []
    for w in (6, width):
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :w] = np.frombuffer(data, dtype=np.uint8, count=n * w, offset=at).reshape(n, w)
        out.append(wide.view("<u8").reshape(-1).view(np.int64))
        at += n * w
    return np.stack(out)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    a = mix(s ^ _C[1]).sum(dtype=np.uint64) + np.uint64(len(s))
    b = mix(s + _C[2]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _families(key: np.ndarray, doc: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of keys in order, each with its documents in order: rows (first document, document,
    number of keys, bits of those with ``held``) of the keys with several documents, the
    first one included."""
    new = np.append(True, key[1:] != key[:-1])
    first = np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), len(key))))
    several = np.append(~new[1:], False) | ~new
    pairs, place = np.unique(np.stack([first[several], doc[several]], axis=1), axis=0, return_inverse=True)
    place = place.reshape(-1)
    bits = np.zeros(len(pairs), dtype=np.uint64)
    bit = np.uint64(1) << (key[several].astype(np.uint64) & np.uint64(63))
    np.bitwise_or.at(bits, place, np.where(held[several], bit, np.uint64(0)))
    count = np.bincount(place, minlength=len(pairs)).astype(np.int64)
    return np.concatenate([pairs, np.stack([count, bits.view(np.int64)], axis=1)], axis=1)


def _blocks(n: int, percent: int, parts: int):
    """Documents to packed blocks: (part, keys with a document, those with others behind
    it, documents, families in the batch)."""
    classes = size_classes(percent)

    def run(batches):
        for b in portions(batches, lambda b: b["t"].map(lambda t: [t]), 1 << 20):
            rows, keys, of, seen = [], [], [], set()
            for doc, text in zip(b["k"], b["t"]):
                s = shingles(text, n)
                a, c = _set_hash(s)
                rows.append((doc, len(s), a))
                if len(s) and doc != NO_ID and (a, c) not in seen:
                    seen.add((a, c))
                    k = candidate_keys(s, percent, classes)
                    keys.append(k)
                    of.append(np.full(len(k), doc, dtype=np.int64))
            out = []
            local = np.empty((0, 4), dtype=np.int64)
            if keys:
                k, d = np.concatenate(keys), np.concatenate(of)
                _, place, count = np.unique(k, return_inverse=True, return_counts=True)
                of_doc = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
                shared = np.bincount(of_doc, weights=count[place.reshape(-1)] > 1, minlength=len(keys))[of_doc]
                order = np.lexsort((d, -shared, k))
                k, d = k[order], d[order]
                if len(k):
                    local = _families(k, d, np.ones(len(k), dtype=bool))
                new = np.append(True, k[1:] != k[:-1])[:len(k)]
                alone = np.append(new[1:], True)[new]  # nobody behind the sender
                k, d = k[new], d[new]
                part = ((k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(part, np.arange(parts + 1))
                for p in np.unique(part):
                    x = slice(cut[p], cut[p + 1])
                    out.append((int(p), *(_pack(k[x][i], d[x][i]) if i.any() else b"" for i in (alone[x], ~alone[x])), b"", b""))
            if rows:
                out.append((rows[0][2] % parts, b"", b"", np.array([(*r, 0) for r in rows], dtype=np.int64).tobytes(), local.tobytes()))
            yield pd.DataFrame(out, columns=["part", "sent", "held", "docs", "local"])

    return run


_FOUND = "kind int, a long, b long, c long, d long"
_DOC, _LOCAL, _MET = range(3)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: its documents (id, size, set), the families inside batches, and
    those of the documents that batches sent with equal keys."""
    blocks = [(_unpack(x), held) for held, c in enumerate(("sent", "held")) for x in pdf[c] if x]
    met = np.empty((0, 4), dtype=np.int64)
    if blocks:
        k, d = np.concatenate([x for x, _ in blocks], axis=1)
        held = np.concatenate([np.full(x.shape[1], h, dtype=bool) for x, h in blocks])
        order = np.lexsort((d, k))
        met = _families(k[order], d[order], held[order])
    found = [[np.frombuffer(x, dtype=np.int64).reshape(-1, 4) for x in pdf[c] if x] for c in ("docs", "local")] + [[met]]
    return pd.concat([pd.DataFrame({"kind": kind, "a": r[:, 0], "b": r[:, 1], "c": r[:, 2], "d": r[:, 3]})
                      for kind, tables in enumerate(found) for r in tables], ignore_index=True)


def _links(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int):
    """Places (i, j) of the similar pairs of x, or between x and y, found from
    incidence matrices over fragments of the order."""
    sets = x if y is None else x + y
    size = np.array([len(s) for s in sets])
    at = np.repeat(np.arange(len(sets)), size)
    grams, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((len(x), len(sets) if y is None else len(y)), dtype=np.float32)
    shared = np.flatnonzero(count > 1)  # the others overlap with nothing
    rank = np.full(len(grams), -1)
    rank[shared] = np.arange(len(shared))
    rank = rank[place]
    order = np.argsort(rank, kind="stable")
    rank, at = rank[order], at[order]
    for low in range(0, len(shared), FRAGMENT):
        cut = slice(*np.searchsorted(rank, [low, low + FRAGMENT]))
        m = np.zeros((len(sets), min(FRAGMENT, len(shared) - low)), dtype=np.float32)
        m[at[cut], rank[cut] - low] = 1
        common += m[:len(x)] @ (m if y is None else m[len(x):]).T
    other = size if y is None else size[len(x):]
    similar = common * 100 >= percent * (size[:len(x), None] + other[None, :] - common)
    return np.argwhere(np.triu(similar, 1) if y is None else similar)


def _forest(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of one family, or of two blocks of it, without those inside what is
    connected already."""
    sides = [pdf[pdf["side"] == i] for i in (0, 1)]
    x, y = ([np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in g]) for g in p["grams"]] for p in sides)
    ids = [p["component"].tolist() for p in sides]
    if not x or (len(sides[1]) == 0 and int(pdf["pair"].iloc[0])):
        return []
    parent = {i: i for p in ids for i in p}

    def top(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in _links(x, y or None, percent):
        a, b = ids[0][i], ids[1 if y else 0][j]
        if top(a) != top(b):
            parent[top(a)] = top(b)
            out.append((a, b))
    return out


def _bitmap(s: np.ndarray, width: int = 0) -> bytes:
    out = np.zeros(width or BITS, dtype=np.uint8)
    out[(mix(s ^ _C[3]) % np.uint64(len(out))).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _wide(s: np.ndarray) -> bytes | None:
    """A bitmap of two to four bits for each n-gram, ``BITS`` times a power of two; none
    where ``_bitmap`` has as many."""
    width = BITS
    while width < 2 * len(s):
        width *= 2
    return _bitmap(s, width) if width > BITS else None


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes, or that times a power of two, as rows of that width:
    the bit of an n-gram is its hash modulo the width."""
    out = np.zeros((len(maps), width), dtype=np.uint8)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, dtype=np.uint8).reshape(-1, width), axis=0)
    return out


def _may_link(n, ones, other_n, other_ones, common, percent: int):
    """Whether sets may be similar, by their sizes, the bits in their bitmaps and the bits in both."""
    most = np.minimum(n - (ones - common), other_n - (other_ones - common))
    return most * 100 >= percent * (n + other_n - most)


def _likely(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of one task: the rows of each (pivot, block) whose document may link with the pivot."""
    out = []
    for _, f in pdf.sort_values("member", kind="stable").groupby(["pivot", "block"]):
        if f["member"].iloc[0] or len(f) == 1:  # no pivot or no members
            continue
        own, f = f.iloc[0], f.iloc[1:]
        width = np.minimum(f["bits"].map(len), len(own["bits"]))
        for w, g in f.groupby(width.to_numpy()):
            x, y = _folded([own["bits"]], w), _folded(g["bits"].tolist(), w)
            ones, common = (np.unpackbits(m, axis=1).sum(axis=1, dtype=np.int64) for m in (y, x & y))
            fine = _may_link(own["n"], np.unpackbits(x).sum(dtype=np.int64), g["n"].to_numpy(), ones, common, percent)
            out.append(g[fine])
    return (pd.concat(out) if out else pdf[:0])[["pivot", "node", "block"]]


_PLACED = "centre long, node long, component long, task long, low int, high int, side int, pair int"


def _looks(f: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document of a block or pair of blocks: the place of the one of another
    component that may be most similar, by the bitmaps ``bits`` and sizes ``n``, and
    the bound of that similarity; 0 if no other one can link with it."""
    b = np.unpackbits(np.frombuffer(b"".join(f["bits"]), dtype=np.uint8).reshape(len(f), -1), axis=1).astype(np.float32)
    n, own, side = f["n"].to_numpy(), f["component"].to_numpy(), f["side"].to_numpy()
    ones, pair = b.sum(axis=1), f["pair"].iloc[0]
    best, score = np.zeros(len(f), dtype=np.int64), np.zeros(len(f))
    for low in range(0, len(f), STRIP):
        x = slice(low, low + STRIP)
        common = b[x] @ b.T
        most = np.minimum(n[x, None] - (ones[x, None] - common), n[None, :] - (ones[None, :] - common))
        union = n[x, None] + n[None, :] - most
        fine = (most * 100 >= percent * union) & (own[x, None] != own[None, :])
        if pair:
            fine &= side[x, None] != side[None, :]
        like = np.where(fine, most / union, 0)
        best[x] = like.argmax(axis=1)
        score[x] = like[np.arange(len(like)), best[x]]
    return best, score


_LOOKS = "centre long, node long, component long, score double, pivot long"


def _lookalikes(families: DataFrame, percent: int) -> DataFrame:
    """The rows of documents that may link with one of another component in their block
    or pair of blocks, each with the one that looks most like it. The others cannot
    link with another component, now or when components have grown."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for centre, f in ((key[0], f) for key, f in pdf.groupby(["centre", "low", "high"])):
            best, score = _looks(f, percent)
            node = f["node"].to_numpy()
            found = pd.DataFrame({"centre": centre, "node": node, "component": f["component"].to_numpy(),
                                  "score": score, "pivot": node[best]})
            out.append(found[score > 0])
        return pd.concat(out, ignore_index=True)

    return families.groupBy("task", "low", "high").applyInPandas(run, _LOOKS)


def _nearest(looks: DataFrame) -> DataFrame:
    """``pivot, node``: of each component the document that looks most like one of
    another component, and that one."""
    best = looks.groupBy("component").agg(F.max(F.struct("score", "pivot", "node")).alias("p")).select("p.*")
    return best.groupBy(F.least("pivot", "node"), F.greatest("pivot", "node")).agg(
        F.max(F.struct("pivot", "node")).alias("p")).select("p.*")


def _has_partner(f: pd.DataFrame, percent: int) -> np.ndarray:
    """Of each document of a block or pair of blocks, by its wide bitmap: whether it may link
    with one of another component. Bitmaps of one width meet with those of no smaller one."""
    width, n, own, side = f["bits"].map(len).to_numpy(), f["n"].to_numpy(), f["component"].to_numpy(), f["side"].to_numpy()
    pair, out = f["pair"].iloc[0], np.zeros(len(f), dtype=bool)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        others = np.flatnonzero((width >= w) & (n * percent <= n[rows].max() * 100))
        b = np.unpackbits(_folded(f["bits"].iloc[others].tolist(), w), axis=1).astype(np.float32)
        ones = b.sum(axis=1)
        at = np.searchsorted(others, rows)
        for low in range(0, len(rows), STRIP):
            x, own_b = rows[low:low + STRIP], at[low:low + STRIP]
            fine = _may_link(n[x, None], ones[own_b, None], n[None, others], ones[None, :], b[own_b] @ b.T, percent)
            fine &= own[x, None] != own[None, others]
            if pair:
                fine &= side[x, None] != side[None, others]
            out[x] |= fine.any(axis=1)
            out[others] |= fine.any(axis=0)
    return out


def _partnered(families: DataFrame, percent: int) -> DataFrame:
    """The rows of documents that may link with one of another component in their
    block or pair of blocks."""
    keep = [c.split()[0] for c in _PLACED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [f[_has_partner(f, percent)] for _, f in pdf.groupby(["centre", "low", "high"])]
        return pd.concat(out, ignore_index=True)[keep]

    return families.groupBy("task", "low", "high").applyInPandas(run, _PLACED)


def _similar(families: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect the components of a family's documents.
    Families of one block share tasks, pairs of blocks have their own."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [e for _, f in pdf.groupby(["centre", "low", "high"]) for e in _forest(f, percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return families.groupBy("task", "low", "high").applyInPandas(run, "a long, b long")


def _partial_overlaps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one task: for each (pivot, fragment, block) the n-grams that each member's
    fragment shares with the pivot's."""
    out = []
    pdf = pdf.sort_values(["pivot", "fragment", "block", "member"], kind="stable", ignore_index=True)
    key = pdf[["pivot", "fragment", "block"]].to_numpy()
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    for low, high in zip(first, np.append(first[1:], len(pdf))):
        if pdf["member"].iloc[low] or high == low + 1:  # no pivot or no members
            continue
        pivot = np.frombuffer(pdf["grams"].iloc[low], dtype=np.uint64)
        sets = [np.frombuffer(b, dtype=np.uint64) for b in pdf["grams"].iloc[low + 1:high]]
        grams = np.concatenate(sets)
        hit = np.zeros(len(grams) + 1, dtype=np.int64)
        if len(pivot) and len(grams):
            hit[1:] = np.cumsum(pivot[np.minimum(np.searchsorted(pivot, grams), len(pivot) - 1)] == grams)
        ends = np.cumsum([len(x) for x in sets])
        common = hit[ends] - hit[np.append(0, ends[:-1])]
        out.append(pd.DataFrame({"pivot": pdf["pivot"].iloc[low], "node": pdf["node"].iloc[low + 1:high].to_numpy(),
                                 "size": pdf["n"].iloc[low], "n": pdf["n"].iloc[low + 1:high].to_numpy(), "common": common}))
    none = pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in ("pivot", "node", "size", "n", "common")})
    return pd.concat(out, ignore_index=True) if out else none


def _pivots(families: DataFrame) -> DataFrame:
    """``pivot, node``: each document with the pivot of its family."""
    best = families.groupBy("node").agg(F.max(F.struct("keys", "centre")).alias("best"), F.sum("keys").alias("degree"))
    placed = best.select("node", "degree", F.col("best.centre").alias("centre"))
    pivots = placed.groupBy("centre").agg(F.max(F.struct("degree", "node")).alias("top"), F.count("*").alias("m")).where("m > 1")
    return placed.join(pivots.select("centre", F.col("top.node").alias("pivot")), "centre").where("node <> pivot").select("pivot", "node")


def _with_pivots(pairs: DataFrame) -> DataFrame:
    """``pivot, node, block, member``: pairs dealt to blocks of at most about
    ``BLOCK_DOCS``, and each block's pivot, which is no member."""
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks"))
    own = blocks.select("pivot", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                        F.lit(0).alias("member"))
    return pairs.join(blocks, "pivot").select(
        "pivot", "node", F.pmod(F.xxhash64("node", "pivot"), "blocks").cast("int").alias("block"), F.lit(1).alias("member")).union(own)


def _likely_pairs(pairs: DataFrame, maps: DataFrame, percent: int, parts: int) -> DataFrame:
    """Those of the pairs of pivots and nodes that may link, by their bitmaps."""
    dealt = (_with_pivots(pairs).join(maps.select("node", "n", F.coalesce("wide", "bits").alias("bits")), "node")
             .withColumn("task", F.pmod(F.xxhash64("pivot", "block"), F.lit(4 * parts))))
    return dealt.groupBy("task").applyInPandas(lambda pdf: _likely(pdf, percent), "pivot long, node long, block int").drop("block")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """``a, b``: the links of ``pairs`` of pivots and nodes, by the overlaps of their fragments."""
    dealt = (_with_pivots(pairs).join(sets, "node")
             .select("pivot", "node", "block", "member", "n", F.posexplode("grams").alias("fragment", "grams"))
             .withColumn("task", F.pmod(F.xxhash64("pivot", "fragment", "block"), F.lit(4 * parts))))
    counted = (dealt.groupBy("task").applyInPandas(_partial_overlaps, "pivot long, node long, size long, n long, common long")
               .groupBy("pivot", "node", "size", "n").agg(F.sum("common").alias("common")))
    return (counted.where(F.col("common") * 100 >= percent * (F.col("size") + F.col("n") - F.col("common")))
            .select(F.col("pivot").alias("a"), F.col("node").alias("b")))


def _dealt(families: DataFrame, label: DataFrame, maps: DataFrame, percent: int, parts: int, scratch: Scratch) -> DataFrame:
    """The families that hold several components, cut into blocks and pairs of them,
    with each document's ``bits``."""
    placed = families.join(label, "node", "left").select(
        "centre", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("centre")
    placed = scratch.keep(placed.join(mixed, "centre").join(maps.select("node", "n"), "node"), "mixed")
    main = (placed.groupBy("centre", "component").agg(F.count("*").alias("m")).groupBy("centre")
            .agg(F.max(F.struct("m", "component")).alias("main")).select("centre", F.col("main.component").alias("main")))
    placed = placed.join(main, "centre").withColumn("inner", F.col("component") == F.col("main"))
    blocks = lambda at: F.greatest(F.ceil(F.count(F.when(at, 1)) / BLOCK_DOCS),
                                   F.ceil(F.sum(F.when(at, F.col("n"))) / BLOCK_NGRAMS)).cast("int")
    shape = placed.groupBy("centre").agg(
        F.min(F.when(~F.col("inner"), F.col("n"))).alias("least"), F.max(F.when(~F.col("inner"), F.col("n"))).alias("most"),
        blocks(~F.col("inner")).alias("outer"), blocks(F.col("inner")).alias("whole"))
    fits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("n") * percent <= F.col("most") * 100)
    spread = F.pmod(F.xxhash64("node", "centre"), F.when(F.col("inner"), F.col("whole")).otherwise(F.col("outer"))).cast("int")
    placed = (placed.join(shape, "centre").where(~F.col("inner") | fits)
              .withColumn("block", spread + F.when(F.col("inner"), F.col("outer")).otherwise(0)))
    # a document outside the main component goes to the pairs of its block with every
    # block, itself included; one inside it to those with every block outside it
    last = F.when(F.col("inner"), F.col("outer")).otherwise(F.col("outer") + F.col("whole")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.least(i, "block").alias("low"), F.greatest(i, "block").alias("high"),
        (F.col("block") > i).cast("int").alias("side"), (F.col("block") != i).cast("int").alias("pair")))
    task = F.when(F.col("outer") + F.col("whole") > 2, F.col("centre")).otherwise(F.pmod(F.xxhash64("centre"), F.lit(4 * parts)))
    return (placed.select("centre", "node", "component", "n", task.alias("task"), F.explode(pairs).alias("p"))
            .select("centre", "node", "component", "n", "task", "p.*").join(maps.select("node", "bits"), "node"))


def groups(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc, n_shingles, component`` of every row. Two documents link when
    100 * intersection >= percent * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text_col).alias("t"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // DOCS_PER_PART)
    found = scratch.keep(own.mapInPandas(_blocks(n, percent, parts), "part int, sent binary, held binary, docs binary, local binary")
                         .groupBy("part").applyInPandas(_meet, _FOUND), "found")
    release(spark)
    rows = found.where(F.col("kind") == _DOC).select(F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("node"))
    real = rows.where((F.col("doc") != NO_ID) & (F.col("n") > 0)).select("doc", "node").distinct()

    def family(kind):
        return (found.where(F.col("kind") == kind).groupBy(F.col("a").alias("centre"), F.col("b").alias("doc"))
                .agg(F.sum("c").alias("keys"), F.bit_or("d").alias("held")))

    local, met = family(_LOCAL), family(_MET)
    lifted = local.select(F.col("centre").alias("sender"), F.col("doc").alias("behind"), F.col("keys").alias("there"), F.col("held").alias("bits")).join(
        met.where("held <> 0"), F.col("sender") == F.col("doc")).where((F.col("held").bitwiseAND(F.col("bits")) != 0) & (F.col("centre") != F.col("sender"))).select("centre", F.col("behind").alias("doc"), F.least("keys", "there").alias("keys"))
    named = local.drop("held").union(met.drop("held")).union(lifted).groupBy("centre", "doc").agg(F.sum("keys").alias("keys"))
    families = scratch.keep(
        named.join(real, "doc").select("centre", "node", "keys")
        .join(real.select(F.col("doc").alias("centre"), F.col("node").alias("of")), "centre")
        .groupBy(F.col("of").alias("centre"), "node").agg(F.sum("keys").alias("keys")), "families")
    release(spark)
    wanted = scratch.keep(real.join(families.select("node").union(families.select(F.col("centre").alias("node"))).distinct(), "node")
                          .groupBy("node").agg(F.min("doc").alias("k")), "wanted")
    bounds = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)
    again = rows.join(wanted, F.col("doc") == F.col("k"), "left_semi").groupBy("doc").agg(F.count("*").alias("m")).where("m > 1")
    twice = again.limit(1).count()  # several rows of one id; else no set comes twice, and none need move

    def sketch(batches):
        for b in portions(batches, lambda b: b["t"].map(lambda t: [t]), 1 << 20):
            sets = [shingles(t, n) for t in b["t"]]
            yield pd.DataFrame({"node": [_set_hash(s)[0] for s in sets], "n": [len(s) for s in sets],
                                "bits": [_bitmap(s) for s in sets], "wide": [_wide(s) for s in sets]})

    def cut(batches):
        for b in portions(batches, lambda b: b["t"].map(lambda t: [t]), 1 << 20):
            sets = [shingles(t, n) for t in b["t"]]
            yield pd.DataFrame({"node": [_set_hash(s)[0] for s in sets], "n": [len(s) for s in sets],
                                "grams": [[x.tobytes() for x in np.split(s, np.searchsorted(s, bounds))] for s in sets]})

    def made(ids, make, schema, name):
        """What ``make`` yields of the documents ``ids``, once for each set."""
        few = F.broadcast(ids) if ids.count() <= BROADCAST_DOCS else ids
        out = own.join(few, "k", "left_semi").mapInPandas(make, schema)
        out = scratch.keep(out.dropDuplicates(["node"]) if twice else out, name)
        release(spark)
        return out

    def sets_of(nodes, name):
        ids = scratch.keep(wanted.join(nodes.distinct(), "node", "left_semi").select("k").distinct(), f"{name}-ids")
        return made(ids, cut, "node long, n long, grams array<binary>", f"{name}-sets")

    def linked(pairs, name):
        """``a, b``: the links of pairs of pivots and nodes; none if no pair is likely."""
        likely = scratch.keep(_likely_pairs(pairs, maps, percent, parts), f"{name}-likely")
        release(spark)
        if not likely.limit(1).count():
            return None
        sets = sets_of(likely.select("node").union(likely.select("pivot")), name)
        out = scratch.keep(_compared(likely, sets, percent, parts), f"{name}-links")
        scratch.drop(f"{name}-likely", f"{name}-ids", f"{name}-sets")
        release(spark)
        return out

    maps = made(wanted.select("k").distinct(), sketch, "node long, n long, bits binary, wide binary", "maps")
    several = real.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a <> hi").select("doc", "a")
    same = real.join(several, "doc").where("node <> a").select("a", F.col("node").alias("b"))  # texts of one document
    found_links = linked(_pivots(families), "pivot")
    label = components(same if found_links is None else found_links.union(same), scratch, "round")

    def extended(new, name):
        return components(new.union(label.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch, name)

    looks = scratch.keep(_lookalikes(_dealt(families, label, maps, percent, parts, scratch), percent), "looks")
    release(spark)
    near = linked(_nearest(looks), "near")
    if near is not None:
        label = extended(near, "nearest")
    families = looks.select("centre", "node").distinct()  # no other document links with another component
    wide = maps.select("node", "n", F.coalesce("wide", "bits").alias("bits"))
    left = scratch.keep(_partnered(_dealt(families, label, wide, percent, parts, scratch), percent), "partnered")
    release(spark)
    if left.limit(1).count():
        more = scratch.keep(_similar(left.join(sets_of(left.select("node"), "rest").select("node", "grams"), "node"), percent), "more")
        release(spark)
        if more.limit(1).count():
            label = extended(more, "last")
    placed = scratch.keep(rows.join(label, "node", "left").select(
        "doc", "n", F.when((F.col("doc") != NO_ID) & (F.col("n") > 0), F.coalesce("component", "node")).alias("of")), "placed")
    first = placed.where("of IS NOT NULL").groupBy("of").agg(F.min("doc").alias("component"), F.count("*").alias("m")).where("m > 1")
    scratch.drop("found", "families", "wanted", "maps", "mixed", "looks", "partnered", "rest-ids", "rest-sets")
    return placed.join(first, "of", "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc"), F.col("n").alias("n_shingles"),
        F.when(F.col("doc") != NO_ID, F.coalesce("component", "doc")).alias("component"))


def join_report(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    out = groups(docs, n, percent)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each linked group: the one with the smallest id, all its
    columns kept; rows without id stay. Rows that share their id but not their text
    are documents of their own."""
    scratch = Scratch(docs.sparkSession, "first")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"))
    several = scratch.keep(named.where("id IS NOT NULL").groupBy("id")
                           .agg(F.min(F.xxhash64("t")).alias("lo"), F.max(F.xxhash64("t")).alias("hi"))
                           .where("lo <> hi").select(F.col("id").alias("several")), "several")
    keyed = named.join(several, F.col("id") == F.col("several"), "left").withColumn(
        "node", F.when(F.col("several").isNull(), F.col("id")).otherwise(F.xxhash64("id", "t")))
    # ids of the keys that are hashes
    ids = keyed.where("several IS NOT NULL").select(F.col("node").alias("doc"), "id").distinct()
    members = scratch.keep(groups(keyed.select("node", "t"), n, percent, "node", "t").where("doc IS NOT NULL")
                           .select("doc", "component").distinct().join(ids, "doc", "left")
                           .select("component", F.struct(F.coalesce("id", "doc").alias("id"), "doc").alias("member")),
                           "members")
    first = members.groupBy("component").agg(F.min("member").alias("first"), F.count("*").alias("m")).where("m > 1")
    later = members.join(first, "component").where("member <> first").select(F.col("member.doc").alias("later"))
    kept = keyed.join(later, F.col("node") == F.col("later"), "left_anti")
    one = kept.where("id IS NOT NULL").dropDuplicates(["node"])
    return one.union(kept.where("id IS NULL")).select("row.*")
