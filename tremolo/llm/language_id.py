"""Language of whole texts: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of character 1- to 3-grams of the lower-cased text, hashed to a
fixed number of buckets; what isn't a letter counts as one blank. Document frequencies are
counted over all rows that may be learned from. The weights are fitted on the driver by
follow-the-regularised-leader with elastic-net penalties, on a bounded sample
(per_language rows of each language), and a temperature fitted on a fifth of the sample
makes the scores probabilities.

Defined cases: a null text, and one without a letter, is `und` with score 0; without any
row to learn from every text is `und`; very long texts count whole; repeated rows get equal
answers; ties go to the language first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import _text as X
from tremolo.llm._sample import per_class

BITS = 15
PER_LANGUAGE = 1500

_CLASS = np.full(128, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)


def letters(text: str) -> np.ndarray:
    """Code points in lower case, runs of ASCII non-letters as one blank, blanks around."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    a = np.where(a < 128, _CLASS[np.minimum(a, 127)], a)
    keep = np.ones(len(a), bool)
    np.logical_or(a[1:] != 32, a[:-1] != 32, out=keep[1:])
    return a[keep]


def has_letter(codes: np.ndarray) -> bool:
    if ((codes > 32) & (codes < 128)).any():
        return True
    return any(chr(c).isalpha() for c in np.unique(codes[codes >= 128]))


def term_counts(codes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams and how often each occurs."""
    shift, k = np.uint32(32 - bits), np.uint32(2654435761)
    one = codes * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
    two = one[:-1] * np.uint32(0x9E3779B1) + codes[1:]
    three = two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:]
    at = np.concatenate([one, two, three])
    at ^= at >> np.uint32(15)
    at *= k
    at >>= shift
    n = np.bincount(at, minlength=1 << bits)
    used = np.flatnonzero(n)
    return used, n[used]


def vector(codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length TF-IDF weights."""
    used, n = term_counts(codes)
    x = (1 + np.log(n)) * idf[used]
    return used, x / max(np.sqrt((x * x).sum()), 1e-12)


class Model:
    """languages, the buckets with weights, their weights and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.bias, self.temperature = languages, idf.astype(np.float32), bias, temperature
        used = np.flatnonzero((weights != 0).any(axis=1))
        self.row = np.zeros(len(idf), np.int32)
        self.row[used] = 1 + np.arange(len(used))
        self.weights = np.vstack([np.zeros((1, len(languages))), weights[used]])

    def logits(self, codes: np.ndarray) -> np.ndarray:
        used, x = vector(codes, self.idf)
        return x @ self.weights[self.row[used]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text:
            return "und", 0.0
        codes = letters(text)
        if not has_letter(codes):
            return "und", 0.0
        z = self.logits(codes) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(rows: list[tuple[str, str]], idf: np.ndarray, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.02, epochs: int = 2) -> Model:
    """rows: (text, language). FTRL-proximal, one language against the others by softmax."""
    languages = sorted({x for _, x in rows})
    at = {x: i for i, x in enumerate(languages)}
    docs = [(vector(c, idf), at[lang]) for text, lang in rows if has_letter(c := letters(text))]
    order = np.random.default_rng(7).permutation(len(docs))
    kept = set(order[: len(docs) // 5].tolist()) if len(docs) >= 20 else set()
    z, n = np.zeros((len(idf) + 1, len(languages))), np.zeros((len(idf) + 1, len(languages)))
    bias_at = len(idf)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((1 + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        for d in order:
            if d in kept:
                continue
            (used, x), y = docs[d]
            used, x = np.append(used, bias_at), np.append(x, 1.0)
            w = weights(used)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[used])
            n[used] += g * g
            z[used] += g - (np.sqrt(n[used]) - root) / alpha * w
    w = weights(slice(None))
    model = Model(languages, idf, w[:-1], w[-1], 1.0)
    if kept:
        s = np.array([docs[d][0][1] @ model.weights[model.row[docs[d][0][0]]] + model.bias for d in kept])
        y = np.array([docs[d][1] for d in kept])
        grid = np.geomspace(0.05, 10, 60)
        model.temperature = float(min(grid, key=lambda t: _loss(s / t, y)))
    return model


def _loss(s: np.ndarray, y: np.ndarray) -> float:
    s = s - s.max(axis=1, keepdims=True)
    return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())


@X.releases
def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                rows += 1
                df[term_counts(letters(text.as_py()))[0]] += 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], rows))], ["bucket", "n"])


@X.releases
def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [model.predict(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """rows: doc_id, text and lang; those with a null text or lang teach nothing."""
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.select("text").mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()
    df, total = np.zeros(1 << BITS), 0
    for bucket, n in counts:
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = per_class(rows, "lang", "doc_id", per_language).collect()
    return fit([(r.text, r.lang) for r in sorted(sample, key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.text))], idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs(doc_id, held_out, text)."""
    docs = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_predict, model=model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


@X.releases
def _keep(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [model.predict(x.as_py()) for x in batch.column(text_at)]
        yield batch.filter(pa.array([lang != "und" and s >= least for lang, s in got], pa.bool_()))


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose text has a language of at least this score."""
    return docs.mapInArrow(partial(_keep, model=model, text_at=docs.columns.index("text"), least=least), docs.schema)
