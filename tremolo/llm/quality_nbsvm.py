"""Quality scores of whole texts: Naive Bayes support vectors.

Features are indicators of n-grams: byte 1- to 4-grams, pairs of word shapes, and whether
words and word triples come again, all hashed to a fixed number of buckets. Each indicator
is scaled by the log ratio of its smoothed counts in the two classes and rows are brought
to unit length; a linear model with hinge loss is fitted by dual coordinate descent, and a
sigmoid fitted on the fifth of the sample that the descent didn't see turns margins into
scores. All fitting is on a bounded sample (per_label rows of each label).

Defined cases: null and empty texts have no indicator and get the score of the bias alone;
without labelled rows of both labels every score is the share of label 1, or 0.5 without
any; very long texts count whole; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import _text as X

BITS = 16
PER_LABEL = 3000
THRESHOLD = 0.7

#: Shape of a byte in a word: upper, lower, digit, beyond ASCII, mark.
_SHAPE = np.full(256, 5, np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 2


def _put(flags: np.ndarray, codes: np.ndarray, kind: int) -> None:
    at = codes * np.uint32(0x9E3779B1) + np.uint32(kind * 0x3C6EF372 & 0xFFFFFFFF)
    at ^= at >> np.uint32(15)
    at *= np.uint32(0x85EBCA6B)
    flags[at >> np.uint32(32 - BITS)] = True


def indicators(t: X.Text) -> Iterator[np.ndarray]:
    """Buckets that are set, for each text of a column in turn."""
    flags = np.zeros(1 << BITS, bool)
    for first, last, s in X.slices(t):
        w = X.words_of(s, s.data, X.SPACE_WORD[s.data])
        triples = X.windows(w.hashes, 3)
        shapes = (_SHAPE[s.data[w.starts]] * 49 + _SHAPE[s.data[w.ends - 1]] * 7 + _SHAPE[s.data[(w.starts + w.ends) // 2]]).astype(np.uint32) if len(w.starts) else np.zeros(0, np.uint32)
        for i in range(last - first):
            b = s.data[s.offsets[i] : s.offsets[i + 1]].astype(np.uint32)
            flags[:] = False
            for n in range(1, 5):
                if len(b) >= n:
                    code = b[: len(b) - n + 1]
                    for k in range(1, n):
                        code = code << np.uint32(8) | b[k : len(b) - n + 1 + k]
                    _put(flags, code, n)
            x, y = w.first[i], w.first[i + 1]
            if y - x >= 2:
                _put(flags, shapes[x : y - 1] * np.uint32(1024) + shapes[x + 1 : y], 5)
                h = w.hashes[x:y]
                if (h[1:] == h[:-1]).any():
                    _put(flags, np.array([1], np.uint32), 6)
                again = 1 - len(np.unique(triples[x : max(x, y - 2)])) / max(1, y - 2 - x)
                _put(flags, np.array([int(10 * again)], np.uint32), 7)
            yield np.flatnonzero(flags)


class Model:
    """Weight of each bucket (with the log ratio in it), bias, and the sigmoid's two numbers."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.square, self.weights = (ratio * ratio).astype(np.float32), (ratio * weights).astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def margin(self, used: np.ndarray) -> float:
        return float(self.weights[used].sum(dtype=np.float64) / max(np.sqrt(self.square[used].sum(dtype=np.float64)), 1e-9)) + self.bias

    def score(self, used: np.ndarray) -> float:
        z = self.slope * self.margin(used) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[str, int]], cost: float = 1.0, epochs: int = 15, smooth: float = 1.0) -> Model:
    """rows: (text, 0 or 1)."""
    flat, d = np.zeros(1 << BITS), 1 << BITS
    y = np.array([2 * v - 1 for _, v in rows])
    if not len(y) or abs(y.sum()) == len(y):
        share = (1 + y.sum() / len(y)) / 2 if len(y) else 0.5
        return Model(flat, flat, 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    sets = list(indicators(X.text_of(pa.array([x for x, _ in rows], pa.large_string()))))
    order = np.random.default_rng(11).permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    if len(set(y[held])) < 2 or len(set(y[used])) < 2:
        held = used = order
    n = {1: np.full(d, smooth), -1: np.full(d, smooth)}
    for i in used:
        n[y[i]][sets[i]] += 1
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[-1] / n[-1].sum())
    w, bias, dual = np.zeros(d), 0.0, np.zeros(len(rows))
    x = {i: ratio[sets[i]] / max(np.sqrt((ratio[sets[i]] ** 2).sum()), 1e-9) for i in set(used.tolist()) | set(held.tolist())}
    rng = np.random.default_rng(13)
    few = {v: len(used) / (2 * max(1, (y[used] == v).sum())) for v in (1, -1)}
    for _ in range(epochs):
        for i in rng.permutation(used):
            v, s = x[i], sets[i]
            gradient = y[i] * (w[s] @ v + bias) - 1
            new = min(max(dual[i] - gradient / (v @ v + 1), 0.0), cost * few[y[i]])
            step = (new - dual[i]) * y[i]
            if step:
                w[s] += step * v
                bias += step
                dual[i] = new
    margins = np.array([w[sets[i]] @ x[i] + bias for i in held])
    slope, offset = sigmoid(margins, (y[held] + 1) / 2)
    return Model(ratio, w, bias, slope, offset)


def sigmoid(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (m, y), with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum(), (v * m).sum()], [(v * m).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@X.releases
def _score(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = np.array([model.score(x) for x in indicators(X.text_of(batch.column(2)))], float)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, held_out, text)."""
    docs = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_score, model=model, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


@X.releases
def _keep(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [model.score(x) >= threshold for x in indicators(X.text_of(batch.column(text_at)))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least the threshold."""
    return docs.mapInArrow(partial(_keep, model=model, text_at=docs.columns.index("text"), threshold=threshold), docs.schema)
