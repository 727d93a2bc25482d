"""Quality classifier: supervised subword embeddings.

A document's features are its words and the byte n-grams inside words (3 to 5
bytes, word borders marked), hashed into ``2**BITS`` buckets, and one more word
for a word that repeats the word before it. Each bucket has a learned vector; a
document is the average of its features' vectors, and a linear layer with
softmax gives the two classes. Vectors and layer are trained by numpy stochastic
gradient descent on a bounded sample of labelled rows (``SAMPLE_ROWS``).

The layer is linear, so for scoring each bucket's vector is folded into one
number, its logit difference; a score is then the logistic function of the
average over the document, the same value at a fraction of the work.

Null and empty texts have no features: their average is the zero vector and the
score 0.5. A text of any length is scored whole, in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import held_out, map_texts
from tablewash.llm.training import labelled_sample

BITS = 17
DIM = 8
SAMPLE_ROWS = 2000
EPOCHS = 8
RATE = 0.5
THRESHOLD = 0.3
NGRAMS = (3, 4, 5)

_MIX = np.uint32(0x9E3779B1)
_BASE = np.uint32(0x01000193)
_POWERS = np.cumprod(np.full(256, 0x85EBCA6B | 1, dtype=np.uint32), dtype=np.uint32)
_SAME = np.uint32(1)  # the bucket of "repeats the word before it"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _MIX
    return h >> np.uint32(32 - BITS)


def features(data: bytes):
    """Arrays of buckets whose concatenation is the text's features."""
    b = np.frombuffer(b" " + data + b" ", dtype=np.uint8)
    space = _SPACE[b]
    v = np.where(space, np.uint8(32), b).astype(np.uint32)
    h = v
    inner = np.zeros(len(v), dtype=bool)  # a blank strictly inside the n-gram
    for n in range(2, NGRAMS[-1] + 1):
        if len(v) < n:
            break
        if n > 2:
            inner = inner[:len(v) - n + 1] | space[n - 2:len(v) - 1]
        h = h[:len(v) - n + 1] * _BASE + v[n - 1:]
        if n in NGRAMS:
            yield _bucket(h[~inner] + np.uint32(n))
    edge = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(edge):
        start = np.zeros(len(v), dtype=np.int64)
        start[edge] = edge
        place = np.arange(len(v)) - np.maximum.accumulate(start)
        power = _POWERS[place & 255]
        power[space] = 0
        words = np.add.reduceat((v + np.uint32(1)) * power, edge, dtype=np.uint32)
        yield _bucket(words)
        yield np.full(int((words[1:] == words[:-1]).sum()), _SAME, dtype=np.uint32)


def _pieces(text: str | None, size: int = 1 << 20):
    """The text's bytes in pieces of about ``size`` characters, cut at white space."""
    at, text = 0, text or ""
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and end > at + size // 2 and not text[end - 1].isspace():
            end -= 1
        yield text[at:end].encode("utf-8", "replace")
        at = end


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(1 << BITS, dtype=np.int64)
    for piece in _pieces(text):
        for f in features(piece):
            total += np.bincount(f, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def train(sample: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> np.ndarray:
    """Logit difference of each bucket, from rows of buckets, counts and label.
    Without rows of both classes every bucket is neutral."""
    if len({y for _, _, y in sample}) < 2:
        return np.zeros(1 << BITS, dtype=np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), dtype=np.float32)
    rows = []
    for at, n, y in sample:
        at, n = np.asarray(at, dtype=np.int64), np.asarray(n, dtype=np.float32)
        if len(at):
            rows.append((at, n / n.sum(), int(y)))
    # rows of the rarer class are seen more often, at most to the same share
    share = [sum(y == c for _, _, y in rows) for c in (0, 1)]
    repeat = [min(4, max(1, round(max(share) / max(1, s)))) for s in share]
    order = np.array([i for i, (_, _, y) in enumerate(rows) for _ in range(repeat[y])])
    steps, done = EPOCHS * len(order), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            at, w, y = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            seen = vectors[at]
            mean = w @ seen
            z = layer @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            # the averaging weight is scaled by the number of buckets, so that long texts learn as fast
            vectors[at] = seen - (rate * len(at) ** 0.5 * w)[:, None] * (p @ layer)
            layer -= rate * np.outer(p, mean)
    return (vectors @ (layer[1] - layer[0])).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> np.ndarray:
    def run(batches):
        for b in batches:
            found = [_counts(t) for t in b["text"]]
            yield pd.DataFrame({"at": [f[0] for f in found], "n": [f[1] for f in found], "y": b["y"]})

    sample = labelled_sample(docs, labels, label, rows).mapInPandas(run, "at array<int>, n array<float>, y int")
    rows_ = []
    for batch in sample.toArrow().to_batches():  # arrays, not lists of numbers
        at, n = batch.column(0), batch.column(1)
        ends = at.offsets.to_numpy()
        places, counts = at.values.to_numpy(), n.values.to_numpy()
        rows_ += [(places[lo:hi], counts[lo:hi], y) for lo, hi, y in
                  zip(ends[:-1], ends[1:], batch.column(2).to_pylist())]
    return train(sorted(rows_, key=lambda r: (r[2], len(r[0]), r[0][:99].tobytes(), r[1][:99].tobytes())))


def score(docs: DataFrame, model: np.ndarray, keep: list[str], text_col: str = "text",
          name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every document."""
    def one(text):
        total, n = 0.0, 0
        for piece in _pieces(text):
            for f in features(piece):
                total += float(model[f].sum(dtype=np.float64))
                n += len(f)
        return float(1 / (1 + np.exp(-np.clip(total / n, -500, 500)))) if n else 0.5

    return map_texts(docs, keep, text_col, lambda: lambda texts: [[one(t) for t in texts]], {name: "double"})


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, fit(docs, labels, label), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    # whatever the columns are called, they travel in one
    own = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    scored = score(own, fit(docs, labels, label), ["row"])
    return scored.where(F.col("score") >= threshold).select("row.*")
