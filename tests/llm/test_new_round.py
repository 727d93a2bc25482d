"""Conversation repair, exact dedup and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewash.llm import conversation_repair, exact_dedup, queries, source_divergence
from tablewash.llm.common import ready, table

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    ready(spark)


def _sql(sql, frames):
    con = duckdb.connect()
    for name, path in frames.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).fetchall()


# --- exact dedup ------------------------------------------------------------


def _equal_groups(rows):
    texts = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    ids = defaultdict(list)
    for (i, _), t in zip(rows, texts):
        ids[t].append(i)
    least = {t: min((i for i in x if i is not None), default=None) for t, x in ids.items()}
    return sorted([(i, least[t], len(ids[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest())
                   for (i, _), t in zip(rows, texts)], key=repr)


COPIES = ([(5, "a b"), (3, "a\n\t b"), (9, "a  b"), (7, "A b"), (2, " a b"), (11, None), (10, ""), (12, " "), (13, "\n\n"),
           (None, "only"), (None, "only"), (None, "a b"), (20, "x" * 60_000), (21, "x" * 60_000), (22, "é ß"),
           (23, "é ß"), (30, "same"), (30, "same"), (31, "same"), (40, "x\x1cy"), (41, "x y")]
          + [(100 + i, "hot text") for i in range(300)] + [(500 + i, f"only {i}") for i in range(50)])


@pytest.mark.parametrize("bits", [128, 3, 0])
@pytest.mark.parametrize("small", [200_000, 0])
def test_exact_dedup_equals_brute_force(spark, monkeypatch, bits, small):
    """Also with a weak hash, under which many texts collide, and with shuffled joins."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", small)
    weak = exact_dedup.content_hash if bits == 128 else lambda t: F.pmod(F.length(t), F.lit(1 << bits)).cast("string")
    frame = spark.createDataFrame([(i, t, 1.0, "k") for i, t in COPIES], "doc_id long, text string, h double, s string")
    got = [tuple(r) for r in exact_dedup.report(frame, hash_of=weak).collect()]
    want = _equal_groups(COPIES)
    assert sorted(got, key=repr) == want
    kept = exact_dedup.remove_copies(frame, hash_of=weak)
    assert kept.columns == frame.columns
    left = [(r.doc_id, re.sub("[ \t-\r]+", " ", r.text or "")) for r in kept.collect()]
    assert len(left) == len({w[4] for w in want}) == len({t for _, t in left})
    assert sorted(left, key=repr) == sorted({(i, re.sub("[ \t-\r]+", " ", t or "")) for i, t in COPIES
                                             if (i, re.sub("[ \t-\r]+", " ", t or "")) in set(left)}, key=repr)
    assert {i for i, _ in left} <= {w[1] for w in want}


def test_exact_dedup_remove_keeps_one_row_of_a_repeated_row(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (None, "b", "x"), (None, "b", "y")]
    for order in (rows, rows[::-1]):
        got = exact_dedup.remove_copies(spark.createDataFrame(order, "doc_id long, text string, keep string")).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "a"), ("None", "b")]


def test_exact_dedup_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.report(none).collect() == [] and exact_dedup.remove_copies(none).collect() == []


# --- source divergence ------------------------------------------------------


def test_terms_of_all_lengths(spark):
    rnd = random.Random(3)
    signs = "abzAZ é日😀"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    texts += [w * k for w in ("a", "ab", "é") for k in (1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65)]
    texts += ["Hello, HELLO hello!", "", "123", None, "z" * 3000, "x1y2z3", "a\x00b", "[a]`b{c}\x7fd"]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["s", "t"]), t) for t in texts]
    count, docs = Counter(), Counter()
    for lang, source, t in rows:
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        count.update((lang or "", source, w) for w in terms)
        docs.update((lang or "", source, w) for w in set(terms))
    got = source_divergence.term_counts(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    assert {(r.lang, r.source, r.term): (r.n, r.d) for r in got if r.term} == {k: (n, docs[k]) for k, n in count.items()}
    assert {(r.lang, r.source) for r in got if not r.term} == {(a or "", b) for a, b, _ in rows}


def test_terms_of_a_text_longer_than_a_portion(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "PORTION", 64)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["a", "bb", "été", "long" * 30]) for _ in range(80)), "bb a", "w" * 500, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["s"] * 4), pa.array(texts)], names=["l", "s", "t"])
    n, d = Counter(), Counter()
    for out in source_divergence._count([batch.slice(0, 2), batch.slice(2)]):
        for r in out.to_pylist():
            n[r["term"]] += r["n"]
            d[r["term"]] += r["d"]
    want = Counter(w for t in texts for w in t.split())
    assert {k: v for k, v in n.items() if k} == dict(want)
    assert {k: v for k, v in d.items() if k} == {w: sum(w in t.split() for t in texts) for w in want}


def test_radix_order_is_the_byte_order():
    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    order = source_divergence.radix_order(source_divergence._digits(words, 4))
    assert (np.diff(words[order].astype(object)) >= 0).all()


def _divergence(rows, min_docs, top):
    docs, count, groups = defaultdict(set), Counter(), set()
    for k, (lang, source, t) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")):
            docs[lang, w].add(k)
            count[lang, source, w] += 1
    kept = defaultdict(list)
    for (lang, w), ids in docs.items():
        if len(ids) >= min_docs:
            kept[lang].append(w)

    def share(c, total, v):
        return 1 + 1_000_000_000 * (c + 2) // (total + 2 * v)

    def shares(lang, sources):
        n = {w: sum(count[lang, s, w] for s in sources) for w in kept[lang]}
        return {w: share(n[w], sum(n.values()), len(n)) for w in n}

    out = []
    for lang, source in groups:
        others = [s for x, s in groups if x == lang]
        p, q = shares(lang, [source]), shares(lang, others)
        far = [(s, sum((p[w] - r[w]) ** 2 // (p[w] + r[w]) for w in p)) for s in others if s != source
               for r in [shares(lang, [s])]]
        near = [(w, (p[w] - q[w]) ** 2 // (p[w] + q[w])) for w in p if count[lang, source, w] and p[w] > q[w]]
        for part, items, most in (("pair", far, None), ("term", near, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, w, v, k + 1) for k, (w, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 20, 8])
def test_divergence_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    rnd = random.Random(6)
    words = ["a", "B", "été", "Wort", "ein langes", "x" * 20, "y" * 40, "日本", "zzzzzzzzz"]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", "é", None]),
             " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for _ in range(120)]
    rows += [("fr", "s0", "rare"), ("fr", "s1", None), ("it", "s0", ""), (None, None, None)] + [rows[0]] * 3
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term long, p int")
    got = sorted(tuple(r) for r in source_divergence.audit(frame, 3, 4).collect())
    assert got == _divergence(rows, 3, 4)
    assert source_divergence.audit(frame.limit(0)).collect() == []


# --- conversation repair ----------------------------------------------------


def _edits(rows):
    """Cheapest (cost, audit) by trying edit strings from the back, and the faults."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                      "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    later = {st: min([(0, "")] * (st in (0, 3)) + [(2 * k, "I" * k) for k in (1, 2)
                                                     if (st, k) in ((2, 1), (1, 2), (3, 2), (0, 2))], default=(99, ""))
             for st in range(4)}
    for (role, _), fault in reversed(list(zip(rows, faults))):
        late = fault == "truncated"

        def here(st):
            out = [(3 + later[st][0], "D" + later[st][1])]
            if fault not in ("blank", "duplicate"):
                for i, to in step[st].items():
                    if role[:1] == i:
                        out.append((late + later[to][0], "K" + later[to][1]))
                    if i != "s":
                        out.append((2 + late + later[to][0], "R" + later[to][1]))
            return min(out)

        plain = {st: here(st) for st in range(4)}
        now = dict(plain)
        for st in range(4):
            at, k = st, 0
            while k < 4:
                at, k = [t for i, t in step[at].items() if i != "s"][0], k + 1
                now[st] = min(now[st], (2 * k + plain[at][0], "I" * k + plain[at][1]))
        later = now
    return later[0], Counter(faults)


def _repair(rows, audit):
    out, st, rows = [], 0, list(rows)
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    for e in audit:
        role, text = ("", "") if e == "I" else rows.pop(0)
        if e == "D":
            continue
        if e in "IR":
            role = "assistant" if st == 2 else "user"
        st = step[st][role[0]]
        out.append(f"{role}:{text}")
    assert not rows and st in (0, 3)
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def _digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _conversations(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        convs[c]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[c] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, _digest(r[1], r[2])))
        (cost, audit), faults = _edits([r[1:] for r in own])
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
                    faults["truncated"], illegal, cost, audit, _repair([r[1:] for r in own], audit)))
    return sorted(out, key=repr)


def _made(n):
    rnd = random.Random(n)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rnd.choice([t, t, t, t, t + 3, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         rnd.choice(["Yes.", "No!", "So?", "and then", " ", None, "", "Good. \n", "wait,\t", "日本。"])))
    return rows


@pytest.mark.parametrize("fan_in, parts", [(32, "8"), (2, "13")])
def test_repair_equals_brute_force(spark, monkeypatch, fan_in, parts):
    monkeypatch.setattr(conversation_repair, "FAN_IN", fan_in)
    rows = _made(150) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 1, "user", "Hi.")]
    rnd = random.Random(9)  # a conversation that fills many tasks
    rows += [(-7, t // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", f"Say {t}.", ""])) for t in range(1500)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, part int, kind string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in conversation_repair.damage_report(frame).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == _conversations(rows)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_conversation_repair(spark, SF).collect()), key=repr)
    assert got == _conversations(rows)


def test_cells_by_any_cut_and_all_edit_strings():
    """Cells equal full CYK over every cut; the best audit is the best of all edit strings."""
    from itertools import product

    rnd = random.Random(10)
    for _ in range(60):
        symbols = "".join(rnd.choice("suaxSUAXd") for _ in range(rnd.randint(1, 4)))
        cells = conversation_repair.parse(symbols)
        for k in range(1, len(symbols)):
            assert conversation_repair.combine(conversation_repair.parse(symbols[:k]), conversation_repair.parse(symbols[k:])) == cells
        best = (0, "") if not symbols else (99, "")
        for size in range(len(symbols) + 4):
            for audit in map("".join, product("DIKR", repeat=size)):
                if size - audit.count("I") != len(symbols):
                    continue
                states, at = {(0, 0)}, 0
                for e in audit:
                    after = set()
                    x = symbols[at] if e != "I" else ""
                    for st, cost in states:
                        steps = conversation_repair.STEPS[st]
                        if e == "D":
                            after.add((st, cost + 3))
                        elif e == "I":
                            after |= {(steps[i], cost + 2) for i in "ua" if i in steps}
                        elif x != "d" and e == "R":
                            after |= {(steps[i], cost + 2 + x.isupper()) for i in "ua" if i in steps}
                        elif x != "d" and x.lower() in steps:
                            after.add((steps[x.lower()], cost + x.isupper()))
                    states, at = after, at + (e != "I")
                best = min([best, *((c, audit) for st, c in states if st in (0, 3))])
        assert conversation_repair.cheapest(cells) == best


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", ""), (2, 0, "assistant", "Yes."), (3, 0, "tool", " ")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in conversation_repair.repaired(frame).collect())
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Still there?"),
                   (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Yes.")]
    assert {r.conv_id: (r.cost, r.audit) for r in conversation_repair.report(frame).collect()} == {
        1: (5, "KRD"), 2: (2, "IK"), 3: (3, "D")}
    assert conversation_repair.report(frame.limit(0)).collect() == []
    assert conversation_repair.repaired(frame.limit(0)).collect() == []


# --- SQL --------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
    want = _sql(queries.ORACLE_SQL[name], {"documents": f"{SF}/documents.parquet"})
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- toxicity: the same model for any layout --------------------------------


def test_toxicity_does_not_depend_on_the_layout(spark):
    from tablewash.llm import toxicity

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    models = []
    try:
        for parts, frame in (("8", docs), ("13", docs), ("8", docs.orderBy(F.xxhash64("doc_id")).repartition(5, "source"))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            models.append(toxicity.fit(frame, labels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert models[0][0] or models[0][1]
    for m in models[1:]:
        assert m[:3] == models[0][:3] and (m[3] == models[0][3]).all()


def test_toxicity_scores_equal_a_plain_scorer(spark):
    """Features from plain edit distances and the logistic function, document by document."""
    from tablewash.llm import toxicity

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    words, stems, radius, w = model
    scorer = toxicity.Scorer(words, stems, radius)
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: 1 / (1 + np.exp(-(np.array(scorer.features(r.text)) @ w[:5] + w[5]))) if words or stems else 0.0 for r in rows}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
