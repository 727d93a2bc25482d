"""Toxicity: misspelling-tolerant lexicon hits, judged in their context.

The lexicon is learned from a bounded sample of labelled rows (``SAMPLE_ROWS``),
of which near copies count once (of rows that share one of two min-hashes of their
word pairs, that with the smallest hash): whole words, and word beginnings of 4 to 6 characters, whose
document counts lean to the toxic class beyond chance (``MIN_G2``). Its trie is intersected with the
Levenshtein automata of the terms: a state is a set of (trie node, edits so far),
determinised lazily, so a word is tested against the whole lexicon in one walk
over its characters. Whole words may differ by one edit from five characters on,
by two from nine on, unless clean sample rows hold words so near
(``MAX_CLEAN_SHARE``); beginnings must match as they are.

Each hit is weighed by its context: quotation marks around it or a reporting
word in a window of ``WINDOW`` words on either side make it a mention, not abuse.
A document's features are the sums of its hits by kind (exact, misspelled,
beginning; abuse or mention) and their density; a logistic regression fitted by
numpy on the same sample turns them into the score.

Null and empty texts have no hits and get the score of a text without hits.
Texts of any length are read whole. Without labels of both classes the lexicon
is empty and every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch, held_out, map_texts
from tablewash.llm.training import labelled_sample

SAMPLE_ROWS = 20_000
MIN_G2 = 30.0
MIN_PURITY = 0.95
MAX_CLEAN_SHARE = 0.001
STEMS = (4, 5, 6)
WINDOW = 6
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTES = re.compile(r"[\"“”„«»‹›‘]|(?<!\w)'|'(?!\w)")
_REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word slur insult "
                       "dijo dice llamó palabra dit écrit appelé mot insulte sagte schrieb nannte wort zitat".split())
EXACT, FUZZY, STEM = 0, 1, 2


def _edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of terms intersected with their Levenshtein automata."""

    def __init__(self, words: list[str], stems: list[str], radius: dict[str, int] | None = None,
                 max_states: int = 200_000):
        radius = {} if radius is None else radius
        self.words = words
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]  # edits allowed for the whole word that ends here
        self.stem_at: list[bool] = [False]
        self.room: list[int] = [0]  # most edits any word below allows
        self.term_at: dict[int, int] = {}
        for i, w in enumerate(words):
            edits = radius.get(w, _edits(w))
            node = self._path(w, edits)
            self.word_at[node], self.term_at[node] = edits, i
        for s in stems:
            self.stem_at[self._path(s, 0)] = True
        self.max_states, self.known = max_states, {}
        self._reset()

    def _path(self, term: str, edits: int) -> int:
        node = 0
        self.room[0] = max(self.room[0], edits)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word_at.append(-1)
                self.stem_at.append(False)
                self.room.append(0)
            node = self.children[node][c]
            self.room[node] = max(self.room[node], edits)
        return node

    def _reset(self) -> None:
        self.states, self.index, self.moves, self.ends = [], {}, [], []
        self._state({0: 0}, False)

    def _state(self, at: dict[int, int], stem: bool) -> int:
        """at: the fewest edits for each trie node."""
        queue = list(at)  # characters of the term that the word lacks
        while queue:
            node = queue.pop()
            for child in self.children[node].values():
                e = at[node] + 1
                if e <= self.room[child] and e < at.get(child, 9):
                    at[child] = e
                    queue.append(child)
        key = (frozenset(at.items()), stem)
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append((at, stem))
            self.moves.append({})
            exact = any(e == 0 and self.word_at[n] >= 0 for n, e in at.items())
            fuzzy = any(e <= self.word_at[n] for n, e in at.items())
            self.ends.append(EXACT if exact else STEM if stem else FUZZY if fuzzy else -1)
        return self.index[key]

    def _move(self, state: int, c: str) -> int:
        at, stem = self.states[state]
        to: dict[int, int] = {}

        def reach(node, e):
            if e <= self.room[node] and e < to.get(node, 9):
                to[node] = e

        for node, e in at.items():
            child = self.children[node].get(c)
            if child is not None:
                reach(child, e)
                stem = stem or e == 0 and self.stem_at[child]
            reach(node, e + 1)  # one character too many
            for other in self.children[node].values():
                reach(other, e + 1)  # another character
        self.moves[state][c] = out = self._state(to, stem)
        return out

    def near(self, word: str) -> dict[int, int]:
        """Terms within their number of edits of the word, but not the word itself, with the edits."""
        state = 0
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
        return {self.term_at[n]: e for n, e in self.states[state][0].items() if 0 < e <= self.word_at[n]}

    def kind(self, word: str) -> int:
        """EXACT, FUZZY, STEM or -1."""
        if len(self.states) > self.max_states:
            self._reset()
        state, moves = 0, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            at, stem = self.states[state]
            if not at:
                return STEM if stem else -1
        return self.ends[state]


class Scorer:
    def __init__(self, words: list[str], stems: list[str], radius: dict[str, int], cache: int = 500_000):
        self.lexicon, self.cache = Lexicon(words, stems, radius), cache
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {}

    def features(self, text: str | None) -> list[float]:
        """Exact, misspelled and stem hits as abuse, all hits as mentions, and abuse per 100 words."""
        lower = (text or "").lower()
        words = _WORD.findall(lower)
        seen = set(words)
        if len(self.clean) > self.cache:
            self.clean.clear()
        for w in seen - self.clean:
            if w not in self.hits:
                kind = self.lexicon.kind(w)
                if kind < 0:
                    self.clean.add(w)
                elif len(self.hits) < self.cache:
                    self.hits[w] = kind
        found = [0.0] * 4
        if any(w in self.hits or w not in self.clean for w in seen):
            spans = [(m[0], m.start(), m.end()) for m in _WORD.finditer(lower)]
            for i, (w, start, end) in enumerate(spans):
                if w in self.clean:
                    continue
                kind = self.hits.get(w)
                kind = self.lexicon.kind(w) if kind is None else kind
                if kind >= 0:
                    found[3 if self._mention(lower, spans, i) else kind] += 1
        return [*map(math.log1p, found), 100 * sum(found[:3]) / max(1, len(words))]

    @staticmethod
    def _mention(lower: str, spans, i: int) -> bool:
        """True if the hit stands between quotation marks, or after a reporting
        word and next to one mark."""
        lo, hi = max(0, i - WINDOW), min(len(spans), i + WINDOW + 1)
        before = bool(_QUOTES.search(lower, spans[lo][1], spans[i][1]))
        after = bool(_QUOTES.search(lower, spans[i][2], spans[hi - 1][2] + 1))
        reported = any(spans[j][0] in _REPORTING for j in range(lo, i))
        return before and after or reported and (before or after)


def _g2(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of a of n1 toxic against b of n0 other documents, 0 if it leans the other way."""
    if a / n1 <= b / n0:
        return 0.0
    p = (a + b) / (n1 + n0)
    part = lambda k, n, q: (k * math.log(k / (n * q)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - q))) if n > k else 0)
    return 2 * (part(a, n1, p) + part(b, n0, p)) if p < 1 else 0.0


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _signatures(text: str) -> tuple[int, int]:
    """Two min-hashes of the text's word pairs."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0, 0
    pairs = {f"{a} {b}" for a, b in zip(words, [*words[1:], ""])}
    h = np.array([zlib.crc32(p.encode()) for p in pairs], dtype=np.uint64)
    return tuple(int((h * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()) for m in (0x9E3779B1, 0x85EBCA6B))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic",
        rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str], dict[str, int], np.ndarray]:
    """Words, stems, words with fewer edits than their length allows, and the
    weights of the regression."""
    def sign(batches):
        for b in batches:
            s = [_signatures(t) for t in b["text"]]
            yield b.assign(s1=[x[0] for x in s], s2=[x[1] for x in s])

    # of rows that share a min-hash the one with the smallest hash of its text stays,
    # whatever the layout; the rows are written once, so every step reads the same
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "s2")).alias("row")
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(
        labelled_sample(docs, labels, label, rows).mapInPandas(sign, "text string, y int, s1 long, s2 long")
        .groupBy("s1", "y").agg(first).select("y", "row.text", "row.s2")
        .groupBy("s2", "y").agg(first).select("row.text", "y"), "sample")
    try:
        return _fit(sample)
    finally:
        scratch.drop("sample")


def _fit(sample: DataFrame) -> tuple[list[str], list[str], dict[str, int], np.ndarray]:

    def count(batches):
        for b in batches:
            toxic, other = Counter(), Counter()
            for text, y in zip(b["text"], b["y"]):
                (toxic if y else other).update(_terms(text))
            names = list(toxic.keys() | other.keys())
            yield pd.DataFrame({"term": names, "a": [toxic[t] for t in names], "b": [other[t] for t in names]})

    counts = (sample.mapInPandas(count, "term string, a long, b long").groupBy("term")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    n1, n0 = next(((r["a"], r["b"]) for r in sample.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).collect()
                   if r["a"] and r["b"]), (0, 0))
    if not n1 or not n0:
        return [], [], {}, np.zeros(6)
    # a term in fewer toxic documents than this cannot be beyond chance, even if no other document has it
    least = next((a for a in range(1, n1 + 1) if _g2(a, 0, n1, n0) >= MIN_G2), n1 + 1)
    pure = F.col("a") / n1 >= MIN_PURITY * (F.col("a") / n1 + F.col("b") / n0)
    good = [r["term"] for r in counts.where((F.col("term") != "") & (F.col("a") >= least) & pure).collect()
            if _g2(r["a"], r["b"], n1, n0) >= MIN_G2]
    words = sorted(t for t in good if not t.endswith("*"))
    stems = sorted(t[:-1] for t in good if t.endswith("*"))

    def near(batches):
        lexicon = Lexicon(words, stems)
        for b in batches:
            n: Counter = Counter()
            for text in b["text"]:
                found = [lexicon.near(w) for w in set(_WORD.findall(text.lower()))]
                n.update({(t, e) for f in found for t, e in f.items()})
            yield pd.DataFrame({"t": [k[0] for k in n], "e": [k[1] for k in n], "n": list(n.values())})

    too_near = (sample.where("y = 0").mapInPandas(near, "t long, e long, n long").groupBy("t", "e")
                .agg(F.sum("n").alias("n")).where(F.col("n") > MAX_CLEAN_SHARE * n0)
                .groupBy("t").agg(F.min("e").alias("e")).collect())
    radius = {words[r["t"]]: r["e"] - 1 for r in too_near}

    def found(batches):
        scorer = Scorer(words, stems, radius)
        for b in batches:
            yield pd.DataFrame({"x": [scorer.features(t) for t in b["text"]], "y": b["y"]})

    got = sample.mapInPandas(found, "x array<double>, y int").toPandas()
    rows = np.array(sorted((*x, y) for x, y in zip(got["x"], got["y"])), dtype=float)  # sums in one order
    x = rows[:, :-1]
    w = _regress(x, rows[:, -1])
    if not x[:, FUZZY].any():  # no misspelled hit to learn from: half as much as an exact one
        w[FUZZY] = max(0.0, w[EXACT]) / 2
    return words, stems, radius, w


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression with balanced classes by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + keep,
                               x.T @ (share * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: tuple[list[str], list[str], dict[str, int], np.ndarray],
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every document, and its hits by kind."""
    words, stems, radius, w = model

    def make():
        scorer = Scorer(words, stems, radius)

        def work(texts):
            x = np.array([scorer.features(t) for t in texts], dtype=float).reshape(len(texts), 5)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:5] + w[5], -30, 30)))
            hits = np.rint(np.expm1(x[:, :4])).astype(int)
            return [p if words or stems else np.zeros(len(texts)), *hits.T]

        return work

    return map_texts(docs, [id_col], text_col, make, {
        "score": "double", "n_exact": "int", "n_misspelled": "int", "n_stem": "int", "n_mentions": "int"})


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the hits of every document."""
    return (score(docs, fit(docs, labels, label))
            .select("doc_id", held_out().alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"),
                    "n_exact", "n_misspelled", "n_stem", "n_mentions"))
