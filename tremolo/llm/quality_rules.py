"""Quality rules: document statistics, fixed limits, and boosted trees with monotone features.

The statistics of whole texts are counted by array kernels. Trees are grown on the driver
from a bounded sample of labelled rows (per_label rows of each label) on binned features
and stored as node arrays, so that scoring is a few array steps for all rows and trees of a
slice at once. More symbols, doubled lines, repeated words or capitals never raise a score:
splits that would are refused, and a split's middle bounds the values below it.

Defined cases: null and empty texts, and texts without words, have all counts 0 and fail the
fixed limits; without labelled rows of both labels the trees keep every text that the limits
keep; repeated rows get equal answers; very long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import _text as X

PER_LABEL = 3000
MIN_WORDS = 50
MAX_REPEATED = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_same")
FEATURES = ("log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "upper_share", "marks_per_word", "distinct_share", "same_share")
#: -1: the score never rises with the feature.
MONOTONE = np.array([0, 0, -1, -1, -1, 0, -1, 0, 0, -1])


def _again(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of equal (owner, h) pairs; owners come in order."""
    _, inverse = np.unique(X.mix(h ^ X.mix(owner.astype(np.uint64))), return_inverse=True)
    return inverse


def statistics(t: X.Text) -> np.ndarray:
    """Row by row the COUNTS of each text."""
    out = np.zeros((len(t), len(COUNTS)), np.int64)
    for first, last, s in X.slices(t):
        data, r = s.data, out[first:last]
        if not len(data):
            continue
        inside = X.SPACE_WORD[data]
        total = X.running(data)
        starts, ends = X.runs(inside, s.offsets)
        at = np.searchsorted(starts, s.offsets)
        r[:, 0] = np.diff(at)
        r[:, 1] = X.counts_between(inside & ((data & 0xC0) != 0x80), s.offsets)
        for k, table in ((2, _SYMBOL), (6, _UPPER), (7, _LETTER), (8, _MARK)):
            r[:, k] = X.counts_between(table[data], s.offsets)
        words = X.hash_spans(total, starts, ends)
        owner = np.repeat(np.arange(last - first), np.diff(at))
        # lines: between newlines; those without a word don't count
        a, b = X.runs(data != 10, s.offsets)
        filled = np.searchsorted(starts, b) > np.searchsorted(starts, a)
        a, b = a[filled], b[filled]
        of = np.searchsorted(s.offsets, a, "right") - 1
        r[:, 5] = np.bincount(of, minlength=last - first)
        if len(a):
            group = _again(of, X.hash_spans(total, a, b))
            _, once = np.unique(group, return_index=True)
            r[:, 3] = r[:, 5] - np.bincount(of[once], minlength=last - first)
        if len(words):
            _, once = np.unique(_again(owner, words), return_index=True)
            r[:, 9] = np.bincount(owner[once], minlength=last - first)
            same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
            r[:, 10] = np.bincount(owner[1:][same], minlength=last - first)
        if len(words) >= 3:
            within = np.flatnonzero(owner[2:] == owner[:-2])
            triples = X.windows(words, 3)[within]
            if len(within):
                group = _again(owner[within], triples)
                twice = within[np.bincount(group)[group] > 1]
                covered = np.zeros(len(words), bool)
                for k in range(3):
                    covered[twice + k] = True
                r[:, 4] = np.bincount(owner[covered], minlength=last - first)
    return out


def features(c: np.ndarray) -> np.ndarray:
    n = np.maximum(c[:, 0], 1)
    return np.column_stack([np.log1p(c[:, 0]), c[:, 1] / n, c[:, 2] / n, c[:, 3] / np.maximum(c[:, 5], 1), c[:, 4] / n, n / np.maximum(c[:, 5], 1), c[:, 6] / np.maximum(c[:, 7], 1), c[:, 8] / n, c[:, 9] / n, c[:, 10] / n])


class Trees:
    """Complete trees in heap order: node k of a tree has children 2 k + 1 and 2 k + 2."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature, self.limit, self.value = np.zeros((0, 0), np.int32), np.zeros((0, 0)), np.zeros((0, 0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.feature.size:
            return out
        tree = np.arange(len(self.feature))[None, :]
        for i in range(0, len(x), 4096):
            rows = x[i : i + 4096]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            for _ in range(self.depth):
                f = self.feature[tree, node]
                node = 2 * node + 1 + (rows[np.arange(len(rows))[:, None], f] > self.limit[tree, node])
            out[i : i + 4096] += self.value[tree, node - (2**self.depth - 1)].sum(axis=1)
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: int = 8, monotone: np.ndarray = MONOTONE) -> Trees:
    """Boosted trees for log odds of y; monotone: -1, 0 or 1 for each feature."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    out = Trees(depth, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    margin, inner, leaves = np.full(len(y), out.base), 2**depth - 1, 2**depth
    kept = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, np.int32), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = (1e-6, None)
            for f, e in enumerate(edges):
                if not len(e) or len(own) < 2 * least:
                    continue
                c = coded[own, f]
                gs, hs, ns = (np.cumsum(np.bincount(c, weights=v, minlength=len(e) + 1)) for v in (g[own], h[own], np.ones(len(own))))
                gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                gr, hr, nr = gs[-1] - gl, hs[-1] - hl, ns[-1] - nl
                vl, vr = np.clip(-gl / (hl + l2), low[k], high[k]), np.clip(-gr / (hr + l2), low[k], high[k])
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
                v = np.clip(-gs[-1] / (hs[-1] + l2), low[k], high[k])
                gain += gs[-1] * v + 0.5 * (hs[-1] + l2) * v**2
                gain[(nl < least) | (nr < least) | (monotone[f] * (vr - vl) < 0)] = -1
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], (f, j, (vl[j] + vr[j]) / 2))
            left, right = 2 * k + 1, 2 * k + 2
            low[left], high[left], low[right], high[right] = low[k], high[k], low[k], high[k]
            if best[1]:
                f, j, middle = best[1]
                feature[k], limit[k] = f, edges[f][j]
                if monotone[f] < 0:
                    low[left], high[right] = middle, middle
                elif monotone[f] > 0:
                    high[left], low[right] = middle, middle
                node[own] = np.where(coded[own, f] > j, right, left)
            else:
                node[own] = left
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        value = rate * np.clip(-gs / (hs + l2), low[inner:], high[inner:])
        value[hs == 0] = 0
        margin += value[leaf]
        kept.append((feature, limit, value))
    out.feature, out.limit, out.value = (np.array(v) for v in zip(*kept))
    return out


def learn(rows: list[tuple]) -> Trees:
    """rows: (doc_id, text, 0 or 1)."""
    counts = statistics(X.text_of(pa.array([r[1] for r in rows], pa.large_string())))
    return fit(features(counts), np.array([r[2] for r in rows], float))


@X.releases
def _apply(batches: Iterator[pa.RecordBatch], model: Trees, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = statistics(X.text_of(batch.column(1)))
        failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEATED * c[:, 0])
        p = 1 / (1 + np.exp(-model.margin(features(c))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], ["doc_id", *COUNTS[:5], "base_failed", "score", "kept"])


def apply_rules(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_apply, model=model, threshold=threshold), f"doc_id {kind}, {', '.join(f'{x} long' for x in COUNTS[:5])}, base_failed boolean, score double, kept boolean")
