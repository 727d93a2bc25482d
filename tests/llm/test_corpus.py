"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tablewash.llm import (bpe, components, decontaminate, fingerprints, jaccard_join, line_dedup, quality, queries,
                            suffix_dedup)
from tablewash.llm.common import Scratch, ready, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    ready(spark)


def _documents(spark, sf=SF):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


# --- Jaccard join -----------------------------------------------------------


def _words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]


def _sets(docs, n):
    out = {}
    for i, t in docs:
        w = _words(t)
        out[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def _groups(sets, percent):
    meet, parent, common = defaultdict(list), {i: i for i in sets}, Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s:
            meet[g].append(i)
    for ids in meet.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, n, percent):
    rnd = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 20, 60, 150]))] for _ in range(12)]
    docs = _documents(spark)[:120]
    for i in range(250):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        docs.append((10_000 - i, rnd.choice([" ", "\n", "  "]).join(words).upper() if i % 9 == 0 else " ".join(words)))
    docs += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one"), (20_004, "ONE"), (20_005, "one two")]
    frame = spark.createDataFrame(docs, SCHEMA)
    sets = _sets(docs, n)
    want = _groups(sets, percent)
    got = jaccard_join.join_report(frame, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = jaccard_join.keep_first(frame, n, percent).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in want if want[i] == i)


@pytest.mark.parametrize("block", [512, 30])
def test_join_large_family(spark, monkeypatch, block):
    """One family of near copies, in one block and in several."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(jaccard_join, "FRAGMENT", 64)
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(80)]
    docs = []
    for i in range(160):
        w = list(words)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(80)] = f"x{rnd.randrange(5)}"
        docs.append((i, " ".join(w)))
    got = jaccard_join.groups(spark.createDataFrame(docs, SCHEMA), 3, 90)
    assert {r.doc: r.component for r in got.collect()} == _groups(_sets(docs, 3), 90)


def test_join_odd_rows(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (1, "a b c d", 3), (1, "a b c d", 4), (2, "a b c d", 5),
            (3, None, 6), (4, "", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_report(frame).collect()), key=repr)
    assert got == sorted([(None, 2, None)] * 2 + [(1, 2, 1)] * 2 + [(2, 2, 1), (3, 0, 3), (4, 0, 4)], key=repr)
    kept = jaccard_join.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, None, 1, 3, 4], key=repr)
    assert jaccard_join.join_report(frame.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_key(percent):
    rnd, classes = np.random.default_rng(percent), jaccard_join.size_classes(percent)
    for _ in range(1500):
        x = np.unique(rnd.integers(0, 1 << 63, rnd.integers(2, 60)).astype(np.uint64) * np.uint64(2))
        y = x.copy()
        for _ in range(rnd.integers(1, 6)):
            if len(y) > 1 and rnd.random() < 0.5:
                y = np.delete(y, rnd.integers(len(y)))
            if rnd.random() < 0.5:
                y = np.unique(np.append(y, rnd.integers(0, 1 << 63, 1).astype(np.uint64)))
        common = len(np.intersect1d(x, y))
        if 100 * common >= percent * (len(x) + len(y) - common) and not np.array_equal(x, y):
            a, b = (jaccard_join.candidate_keys(s, percent, classes) for s in (x, y))
            assert len(np.intersect1d(a, b)), (len(x), len(y))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(frame, Scratch(spark, "test"), "c").collect()}
    assert {n: got[n] for n in got if n != got[n]} == (
        {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200})


# --- suffix-array dedup -----------------------------------------------------


def _covered(docs):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p:p + 50]] = min(i, first.get(b[p:p + 50], i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _copies(seed):
    rnd = random.Random(seed)
    words = ["alpha", "be", "gam", "déjà", "epsilon", "zz", "the", "of"]
    base = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(5)]
    docs = []
    for i in range(150):
        x = rnd.choice(base)
        at = rnd.randrange(len(x))
        part = list(x[at:at + rnd.randint(0, 600)])
        for _ in range(rnd.randint(0, 4)):
            if part:
                part[rnd.randrange(len(part))] = rnd.choice("xyz")
        docs.append((i * 7 - 100, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) + "".join(part)
                     + "a" * rnd.choice([0, 0, 60, 200])))
    return docs + [(5000, None), (5001, ""), (5002, "a" * 3000), (5004, base[0]), (5005, "x" * 49)], base


def _dedup(spark, docs):
    return sorted((tuple(r) for r in suffix_dedup.dedup(spark.createDataFrame(docs, SCHEMA)).collect()), key=repr)


def test_suffix_dedup_equals_brute_force(spark):
    docs, base = _copies(5)
    assert _dedup(spark, docs) == _covered(docs)
    more = docs + [(None, base[0]), (5003, base[0]), (5003, base[0]), (5003, base[1])]  # repeated and missing ids
    assert _dedup(spark, more) == _covered(more)
    assert _dedup(spark, []) == []


def test_suffix_dedup_anchors_are_dealt_evenly():
    rnd, parts = np.random.default_rng(4), 50
    texts = [[bytes(rnd.integers(97, 123, 2000, dtype=np.uint8)).decode()] for _ in range(200)]
    frames = suffix_dedup._cover(parts)(iter([pd.DataFrame({"doc": range(200), "texts": texts})]))
    rows = pd.concat(frames)
    size = rows[rows["kind"] == 2].groupby("part")["n"].sum()
    assert len(size) == parts and size.max() < 1.5 * size.mean()


def test_suffix_dedup_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_GRAM", 3)
    docs, _ = _copies(6)
    assert _dedup(spark, docs) == _covered(docs)


def test_op4_rows(spark):
    got = sorted((tuple(r) for r in queries.op4_suffix_array_dedup(spark, SF).collect()), key=repr)
    assert got == _covered(_documents(spark))


# --- fingerprints -----------------------------------------------------------


def _edited(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        next_, third = order[(k + 1) % len(order)][1], len(t) // 3
        out[i] = (t, t[:len(t) - third] + next_[:third], next_)
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("bucket_rows", [1000, 7])
def test_op6_rows(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    want = _edited(_documents(spark))

    def shingles(t):
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    rows = queries.op6_fingerprints(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        own, edited, next_ = want[r.doc_id]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [shingles(t) for t in (own, edited, next_)]
        assert abs(r.near_edited - _jaccard(sets[0], sets[1])) < 0.2
        assert abs(r.near_next - _jaccard(sets[0], sets[2])) < 0.2
        if len(sets[0]) < 60 and len(sets[1]) < 60:  # both sketches are whole
            assert abs(r.near_edited - _jaccard(sets[0], sets[1])) < 1e-9
        assert abs(r.n_shingles / max(1, len(sets[0])) - 1) < 0.5


def test_fingerprint_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (1, ""), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "x " * 30_000)]
    got = fingerprints.edit_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 1
    one = fingerprints.edit_report(spark.createDataFrame([(1, "abcdef")], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    assert fingerprints.edit_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_merge(spark):
    rnd = random.Random(1)
    a, b = ([f"{rnd.randrange(400)}" for _ in range(300)] for _ in range(2))
    row = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a + ["|"] + b))], "a string, b string, c string")
    from pyspark.sql import functions as F
    s = {c: fingerprints.sketch(F.col(c)) for c in "abc"}
    got = row.select(fingerprints.containment(s["a"], s["c"]).alias("inside"),
                     fingerprints.resemblance(fingerprints.merge(s["a"], s["b"]), s["c"]).alias("whole")).first()
    assert got.inside > 0.8 and got.whole > 0.9


# --- line dedup, decontamination --------------------------------------------


def test_op7_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op7_line_dedup(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.sql(line_dedup.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    for c in got:
        assert got[c].fillna("").tolist() == want[c].fillna("").tolist(), c


def _without_runs(docs, m):
    """Texts by id after brute-force deletion of later copies of runs of m lines, and of single
    lines of 50 words or more; None: no line left."""
    seqs = [(i, [(n, s) for n, s in enumerate((t or "").split("\n")) if s.strip(" \t\r")]) for i, t in sorted(docs)]
    seen, gone = set(), defaultdict(set)
    for i, seq in seqs:
        for k in range(len(seq) - m + 1):
            run = tuple(s for _, s in seq[k:k + m])
            if run in seen:
                gone[i].update(n for n, _ in seq[k:k + m])
            seen.add(run)
        for n, s in seq:
            if len([w for w in re.split("[ \t\x0b\x0c\r]+", s) if w]) >= 50:
                if (s,) in seen and m > 1:
                    gone[i].add(n)
                seen.add((s,))
    out = {}
    for i, t in docs:
        left = [s for n, s in enumerate((t or "").split("\n")) if n not in gone[i]]
        out[i] = t if not gone[i] else "\n".join(left) if any(s.strip(" \t\r") for s in left) else None
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_runs_equal_brute_force(spark, m):
    rnd = random.Random(m)
    docs = [(i, "\n".join(rnd.choice(["a", "b", "c", "", " ", "d e", "f"]) for _ in range(rnd.randint(0, 12))))
            for i in range(60)] + [(100, None), (101, "a\n" * 500)]
    frame = spark.createDataFrame([(i, t, len(t or ""), 1) for i, t in docs], SCHEMA + ", n_chars int, gone int")
    got = line_dedup.remove_runs(frame, m)
    want = {i: t for i, t in _without_runs(docs, m).items() if t is not None or dict(docs)[i] is None}
    assert got.columns == frame.columns
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text or "") for r in rows)


def test_lines_odd_rows(spark):
    rows = [(None, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, ""), (3, None)]
    got = sorted(((r.doc_id, r.n_lines, r.n_deleted) for r in line_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()),
                 key=repr)
    assert got == sorted([(None, 2, 0), (1, 2, 2), (1, 2, 2), (2, 0, 0), (3, 0, 0)], key=repr)
    assert line_dedup.report(spark.createDataFrame([], SCHEMA)).count() == 0


def _similar(window, item):
    a, b = (Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) for w in (window, item))
    return sum((a & b).values()) / sum((a | b).values())


def _leaks(docs, items):
    """Best similarity of every window of the item's length, by document and item."""
    best = {}
    split = lambda t: [w for w in re.split("[ \t\n\x0b\x0c\r]+", (t or "").lower()) if w]
    for i, t in docs:
        w = split(t)
        grams = {tuple(w[k:k + n]) for n in range(1, 6) for k in range(len(w) - n + 1)}
        for item, text in items:
            x = split(text)
            if not x or not w or not any(tuple(x[k:k + 5]) in grams for k in range(max(1, len(x) - 4))):
                continue
            best[i, item] = max(_similar(w[k:k + len(x)], x) for k in range(max(1, len(w) - len(x) + 1)))
    return {k: v for k, v in best.items() if v >= 0.8}


def test_op8_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = queries.op8_decontamination(spark, SF).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == _leaks(_documents(spark), items)


def test_decontamination_of_changed_items(spark):
    rnd = random.Random(9)
    items = [(k, " ".join(f"t{rnd.randrange(500)}" for _ in range(n))) for k, n in enumerate([40, 60, 25, 80, 3, 1])]
    items += [(50, None), (51, ""), (52, items[0][1])]
    docs = []
    for i in range(120):
        w = items[rnd.randrange(6)][1].split()
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(w) + 1)
            w[at:at + rnd.randint(0, 1)] = rnd.choice([[], ["new"]])
        docs.append((i, " ".join([f"x{rnd.randrange(99)}" for _ in range(rnd.randint(0, 9))] + w
                                 + [f"y{rnd.randrange(99)}" for _ in range(rnd.randint(0, 9))])))
    docs += [(200, None), (201, ""), (202, items[0][1].upper())]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], SCHEMA + ", words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _leaks(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame, bench).collect()}
    assert got == want and len({k[1] for k in want}) == 7
    kept = decontaminate.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.matches(frame, bench.limit(0)).count() == 0
    assert decontaminate.matches(frame.limit(0), bench).count() == 0


def test_simhash_is_the_majority_of_each_bit(spark):
    """For lists that take counters of every width."""
    rnd = random.Random(1)
    lists = [[rnd.randrange(-2 ** 63, 2 ** 63) for _ in range(n)] for n in (0, 1, 2, 7, 127, 128, 300, 40_000)]
    lists.append([-1] * 127)
    lists.append([-1] * 32_768)

    def majority(x):
        bits = sum((2 * sum(v >> j & 1 for v in x) > len(x)) << j for j in range(64))
        return bits - (1 << 64) if bits >> 63 else bits

    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, s array<bigint>")
    got = {r.i: r.fp for r in frame.select("i", decontaminate.simhash(frame.s).alias("fp")).collect()}
    assert [got[i] for i in range(len(lists))] == [majority(x) for x in lists]


def test_bitmaps_bound_overlaps_from_above():
    """No pair of similar sets is left without a partner, whatever the bitmap's width."""
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    for bits in (64, 2048):
        jaccard_join.BITS, before = bits, jaccard_join.BITS
        sets = [np.unique(np.concatenate([base[:n], rnd.integers(0, 1 << 63, k, dtype=np.uint64)])) for n, k in
                ((400, 0), (390, 10), (200, 200), (395, 30), (30, 1), (31, 0))]
        maps = [np.unpackbits(np.frombuffer(jaccard_join._bitmap(x), dtype=np.uint8)).astype(bool) for x in sets]
        jaccard_join.BITS = before
        for x, a in zip(sets, maps):
            for y, b in zip(sets, maps):
                assert len(np.intersect1d(x, y)) <= min(len(x) - (a & ~b).sum(), len(y) - (b & ~a).sum())


def test_decontamination_of_moved_passages(spark):
    """Halves swapped and sentences moved inside longer texts: shared shingles at other places."""
    rnd = random.Random(12)
    items = [(k, " ".join(f"t{rnd.randrange(900)}" for _ in range(n))) for k, n in enumerate([100, 100, 60, 150, 8])]
    docs = []
    for i in range(100):
        w = items[rnd.randrange(4)][1].split()
        a, b = sorted(rnd.sample(range(len(w)), 2))
        w = rnd.choice([w[len(w) // 2:] + w[:len(w) // 2], w[:a] + w[b:] + w[a:b], w[b:] + w[a:b] + w[:a], w + w[a:], w[a:b] + w])
        docs.append((i, " ".join([f"x{rnd.randrange(99)}" for _ in range(rnd.randint(0, 40))] + w
                                 + [f"y{rnd.randrange(99)}" for _ in range(rnd.randint(0, 40))])))
    want = _leaks(docs, items)
    assert len(want) > 60
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 20, 0):
        decontaminate.BROADCAST_WINDOWS, before = bound, decontaminate.BROADCAST_WINDOWS
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(spark.createDataFrame(docs, SCHEMA), bench).collect()}
        decontaminate.BROADCAST_WINDOWS = before
        assert got == want


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are called as the operators' own."""
    names = ["id", "row", "t", "r", "text_", "node", "several", "later", "whole", "near", "n", "h", "k", "at", "words", "score", "__quality",
             "__found", "__text", "__several", "__later", "__node", "c0", "component", "gone", "left", "k1"]
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, *range(len(names))), (2, b, *range(len(names))), (3, b, *range(len(names))), (4, None, *range(len(names)))]
    frame = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} long" for c in names))
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    for got, left in ((decontaminate.remove_contaminated(frame, bench), {2, 3, 4}), (jaccard_join.keep_first(frame), {1, 2, 4}),
                      (line_dedup.remove_runs(frame), {1, 2, 3, 4}), (quality.keep_good(frame, table(spark, SF, "labels")), None)):
        assert got.columns == frame.columns
        found = got.collect()
        assert left is None or {r.doc_id for r in found} == left
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in found)


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated ids: only rows with an item, or later copies, go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = " ".join(b.split()[:-1])
    rows = [(None, a, 1), (None, b, 2), (1, a, 3), (1, b, 4), (2, c, 5), (3, None, 6), (3, b, 7), (-5, near, 8), (-5, c, 9),
            (-5, c, 10), (9, near, 11), (-6, b, 12), (-6, c + " x", 13), (-6, "", 14)]
    frame = spark.createDataFrame(rows, SCHEMA + ", n int")
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    left = decontaminate.remove_contaminated(frame, bench)
    assert left.columns == frame.columns
    assert {r.n for r in left.collect()} == {r[2] for r in rows} - {1, 3}
    kept = jaccard_join.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted(r.n for r in kept.collect()) == [1, 2, 3, 6, 12, 13, 14]


# --- pipeline ---------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    good = {r.doc_id for r in queries.op1_quality_classifier(spark, SF).where("predicted = 1").collect()}
    docs = [(i, t) for i, t in _documents(spark) if i in good]
    assert len(docs) < len(_documents(spark))
    docs = [(i, t) for i, t in _without_runs(docs, 2).items() if t is not None]
    group = _groups(_sets(docs, 5), 80)
    docs = [(i, t) for i, t in docs if group[i] == i]
    leaks = {i for i, _ in _leaks(docs, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    docs = [(i, t) for i, t in docs if i not in leaks]
    assert leaks and set(out) == {i for i, _ in docs}
    with open(queries.BPE_RANKS, "rb") as f:
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                  mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    for i, t in docs:
        assert out[i].ids == known.encode_ordinary(t)
        assert out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_bits_of_keys_lift_only_members_with_a_met_key():
    key = np.array([5, 5, 6, 6, 7], dtype=np.uint64)
    got = jaccard_join._families(key, np.array([1, 2, 1, 3, 1]), np.array([True, False, False, True, True]))
    assert sorted(map(tuple, got.tolist())) == [(1, 1, 2, 1 << 5), (1, 2, 1, 0), (1, 3, 1, 1 << 6)]


def test_near_copies_below_the_threshold_end_with_the_bitmaps(spark, monkeypatch):
    """Copies of one text with six of its words changed link with nothing: no document of
    their families is left for the steps after the bitmaps."""
    rnd, seen = random.Random(3), {}
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(600):
        changed = set(rnd.sample(range(60), 6))
        docs.append((i, " ".join(f"x{i}y{j}" if j in changed else w for j, w in enumerate(base))))
    keep = Scratch.keep

    def counted(self, df, name):
        seen[name] = keep(self, df, name)
        if name in ("mixed", "looks", "partnered"):
            seen[f"{name} rows"] = seen[name].count()
        return seen[name]

    monkeypatch.setattr(Scratch, "keep", counted)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(30)
    got = jaccard_join.groups(frame, 3, 90)
    assert {r.doc for r in got.collect() if r.component == r.doc} == set(range(600))
    assert seen["looks rows"] == 0 and seen["partnered rows"] == 0


def test_wide_bitmaps_bound_overlaps_from_above():
    """Bitmaps of sets of any size, the wider folded to the narrower, lose no similar pair."""
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 63, 9000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rnd.integers(0, 1 << 63, k, dtype=np.uint64)])) for n, k in
            ((1000, 0), (1000, 60), (1100, 30), (4000, 90), (4100, 10), (4100, 900), (9000, 0), (8000, 300), (300, 5), (310, 0))]
    wide = [jaccard_join._wide(s) or jaccard_join._bitmap(s) for s in sets]
    assert len({len(b) for b in wide}) > 3
    pair = {(i, j): 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets)}
    assert any(v and len(wide[i]) != len(wide[j]) for (i, j), v in pair.items())
    frame = pd.DataFrame({"node": range(len(sets)), "n": [len(s) for s in sets], "bits": wide, "component": range(len(sets)), "side": 0, "pair": 0})
    has = jaccard_join._has_partner(frame, 80)
    for i in range(len(sets)):
        of = pd.concat([frame.iloc[[i]].assign(member=0), frame.drop(i).assign(member=1)]).assign(pivot=i, block=0)
        left = set(jaccard_join._likely(of, 80)["node"])
        assert left >= {j for j in range(len(sets)) if j != i and pair[i, j]}
        assert has[i] or not any(pair[i, j] for j in range(len(sets)) if j != i)
        few = [j for j in left if not pair[i, j]]  # far pairs go
        assert all(100 * len(np.intersect1d(sets[i], sets[j])) >= 55 * len(np.union1d(sets[i], sets[j])) for j in few)


@pytest.mark.parametrize("words", [60, 3000])
def test_sets_are_made_only_of_candidates_that_bitmaps_leave(spark, monkeypatch, words):
    """Documents that share a part with a pivot but are far from it have no set written,
    long ones neither; the near copies among them still link."""
    rnd, seen = random.Random(5), {}
    docs = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(words)]
        for i in range(10):
            changed = set(rnd.sample(range(words), words // 10))
            docs.append((g * 100 + i, " ".join(f"x{g}y{i}z{j}" if j in changed else w for j, w in enumerate(base))))
        near = docs[-1][1].split()
        near[3] = "other"
        docs.append((g * 100 + 50, " ".join(near)))
    keep = Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        if name.endswith("sets") or name == "families":
            seen[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    want = _groups(_sets(docs, 3), 90)
    got = jaccard_join.groups(spark.createDataFrame(docs, SCHEMA), 3, 90)
    assert {r.doc: r.component for r in got.collect()} == want
    assert len(set(want.values())) in (len(docs) - 12, len(docs))
    assert seen["families"] >= 12
    assert sum(m for name, m in seen.items() if name.endswith("sets")) <= 24 + 12
