r"""Phrases of up to max_n words that keep together, for each language.

Texts are put in lower case (A to Z), split at marks and line ends into pieces, and these into words.
Every batch's 1..max_n-grams become counted rows (lang, phrase, f); Spark sums them by language and
phrase, so a hot phrase is one row of each task. A candidate has 2..max_n words and f >= least.
Its score is that of its weakest cut, floor(scale * a / (l + r)), in decimals. A candidate that a
one-word extension holds at share or more of its count is dropped: a longer one would have such an
extension between, no rarer than itself. The first top of each language are ranked.

Strings of all grams would be many times the texts (nearly all come once), so with sketch_bits the grams are first
counted by 40 bits of a hash of language and phrase, in packed sorted lists by ranges of the hash. What
counts to least there is marked in a bitmap of 2^sketch_bits bits, and only a gram that is marked, with all the shorter
ones in it, becomes a row. Hashes and bits that are shared only let more rows through, and no gram is more frequent
than one in it, so the result is the same with any size, and with none (0).

Defined cases: null texts are empty, a null lang is 'und'; rows that repeat count again, whatever their
ids; an empty table gives no row; ties in score and count are ranked by the phrase's bytes; texts of any length count
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm import _text as X
from tremolo.llm._store import cut

#: Text that is cut into grams at once; its grams are counted before they leave the task.
SLICE_BYTES = 1 << 20
#: Grams that become strings at once.
_AT_ONCE = 1 << 18
SKETCH_BITS = 26
#: Hashes have so many bits; a task packs about so many at once.
_HASH_BITS = 40
_PACKED = 1 << 22
_SALTS = 64

_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_ENDS_PIECE
_WORD[[0x20, 0x09]] = False


def _lang_hash(lang: str) -> np.uint64:
    return X.word_hash(lang + "\n")[0]


def _hashes(hashes: np.ndarray, lang: str) -> np.ndarray:
    return X.mix(hashes ^ _lang_hash(lang)) >> np.uint64(64 - _HASH_BITS)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (X.mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


class Pieces:
    """Words of a slice in one buffer with single blanks between, so that a phrase of a piece is one span."""

    def __init__(self, t: X.Text):
        starts, ends = X.runs(_WORD[t.data], t.offsets)
        n = ends - starts
        self.ends = np.cumsum(n + 1) - 1
        self.starts = self.ends - n
        self.data = np.full(int(self.ends[-1]) + 1 if len(n) else 0, 0x20, np.uint8)
        at = np.repeat(np.arange(len(n)), n) + np.arange(int(n.sum()))
        self.data[at] = X.lower(t.data)[_WORD[t.data]]
        # Words of one piece have the same number of piece ends and text starts before them.
        ended = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum(_ENDS_PIECE[t.data], out=ended[1:])
        self.piece = ended[starts] + np.searchsorted(t.offsets, starts, "right")

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, n: int) -> np.ndarray:
        m = max(len(self) - n + 1, 0)
        return X.hash_spans(X.running(self.data), self.starts[:m], self.ends[n - 1 :]) if m else np.zeros(0, np.uint64)

    def grams(self, n: int, at: np.ndarray) -> pa.Array:
        """The n-grams that start at the given words."""
        first, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        data = self.data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))

    def within(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are of one piece."""
        m = max(len(self) - n + 1, 0)
        return self.piece[:m] == self.piece[n - 1 :] if m else np.zeros(0, bool)


def _rows(lang: str, n: int, phrases: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    m = len(phrases)
    return pa.RecordBatch.from_arrays([pa.repeat(lang, m), phrases.cast(pa.string()), counts.cast(pa.int64()), pa.array(np.full(m, n, np.int32))], ["lang", "phrase", "f", "words"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel().astype(np.int64)


@X.releases
def _sketch(batches: Iterator[pa.RecordBatch], max_n: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """(part, n, gaps, counts): hashes of all grams of up to max_n words by ranges, as gaps from one to the next, and their counts."""
    shift, held, size = np.uint64(_HASH_BITS - ranges), [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        ends = np.searchsorted(keys >> shift, np.arange(1 << ranges), "right")
        for part, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            if b > a:
                gaps = np.diff(keys[a:b], prepend=np.uint64(part) << shift)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b - a], pa.int32()), pa.array([_pack(gaps)], pa.binary()), pa.array([_pack(np.minimum(counts[a:b], 2**32 - 1))], pa.binary())], ["part", "n", "gaps", "counts"])

    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            for _, _, s in X.slices(X.text_of(batch.filter(pc.equal(batch.column(0), lang)).column(1)), SLICE_BYTES):
                p = Pieces(s)
                keys = np.sort(np.concatenate([_hashes(p.hashes(n)[p.within(n)], lang) for n in range(1, max_n + 1)]))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                held.append((keys[first], np.diff(first, append=len(keys))))
                size += len(first)
                if size > _PACKED:
                    yield from packed()
                    held, size = [], 0
    if size:
        yield from packed()


def _marks(rows: pd.DataFrame, least: int, ranges: int, bits: int) -> pd.DataFrame:
    """Bits (place, bit) of one range's hashes that count to least."""
    keys, counts = [], []
    for part, n, gaps, c in zip(rows["part"], rows["n"], rows["gaps"], rows["counts"]):
        keys.append(np.cumsum(_unpack(gaps, n)) + (part << (_HASH_BITS - ranges)))
        counts.append(_unpack(c, n))
    keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
    at = _places(keys[counts >= least].astype(np.uint64), bits)
    return pd.DataFrame({"place": at >> 6, "bit": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})


def bitmap(rows: DataFrame, max_n: int, least: int, bits: int) -> bytes:
    """Marks of all grams of rows(lang, text) that may count to least; at most 2^(bits - 6) numbers reach the driver."""
    # Ranges grow with the input, so that what one task adds up doesn't.
    ranges = min(max(8, (8 * rows.rdd.getNumPartitions()).bit_length()), _HASH_BITS - 16)
    packed = rows.mapInArrow(partial(_sketch, max_n=max_n, ranges=ranges), "part int, n int, gaps binary, counts binary")
    marks = packed.groupBy("part").applyInPandas(lambda _, r: _marks(r, least, ranges, bits), "place long, bit long")
    out = np.zeros(1 << (bits - 6), np.int64)
    got = marks.groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
    out[got["place"].to_numpy()] = got["bit"].to_numpy()
    return out.tobytes()


@X.releases
def _count(batches: Iterator[pa.RecordBatch], max_n: int, marks: bytes | None, bits: int) -> Iterator[pa.RecordBatch]:
    """Counted grams of up to max_n words that are marked; '' counts all words."""
    table = None if marks is None else np.frombuffer(marks, np.uint8)
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            texts = batch.filter(pc.equal(batch.column(0), lang)).column(1)
            for _, _, s in X.slices(X.text_of(texts), SLICE_BYTES):
                p = Pieces(s)
                if len(p):
                    yield _rows(lang, 1, pa.array([""]), pa.array([len(p)]))
                shorter = np.ones(len(p) + 1, bool)
                for n in range(1, max_n + 1):
                    ok = p.within(n) & shorter[:-1] & shorter[1:]
                    at = np.flatnonzero(ok)
                    if table is not None:
                        place = _places(_hashes(X.hash_spans(X.running(p.data), p.starts[at], p.ends[at + n - 1]), lang), bits) if len(at) else at
                        at = at[(table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
                    shorter = np.zeros(len(ok), bool)
                    shorter[at] = True
                    for x in range(0, len(at), _AT_ONCE):
                        got = p.grams(n, at[x : x + _AT_ONCE]).value_counts()
                        yield _rows(lang, n, got.field(0), got.field(1))
                    if len(ok) < 2:
                        break


def frequent_grams(docs: DataFrame, max_n: int, least: int, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(lang, phrase, f, words): the grams of up to max_n words with f >= least, and as phrase '' the number of words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = bitmap(rows, max_n, least, sketch_bits) if sketch_bits else None
    got = rows.mapInArrow(partial(_count, max_n=max_n, marks=marks, bits=sketch_bits), "lang string, phrase string, f long, words int")
    return cut(got.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")))


def mine(docs: DataFrame, max_n: int = 4, least: int = 30, scale: int = 2_000_000, share: tuple[int, int] = (80, 100), top: int = 2000, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first top candidates; docs(text, lang)."""
    grams = frequent_grams(docs, max_n, least, sketch_bits)
    count = grams.where("phrase <> ''").select("lang", "phrase", "f")
    found = grams.where(F.col("words") > 1).select("lang", "phrase", F.col("f").alias("a"), "words")
    # A cut's two parts are at least as frequent as the whole, so they are all among the frequent ones.
    part = lambda first, n: F.array_join(F.slice(F.split("phrase", " "), first, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20, 0)) * cast({scale} as decimal(10, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("c"))
    inner = found.where(F.col("words") > 2).select("lang", F.col("a").alias("whole"), F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    held = inner.join(count, ["lang", "phrase"]).where(F.expr(f"cast(whole as decimal(20, 0)) * {share[1]} >= cast(f as decimal(20, 0)) * {share[0]}")).select("lang", "phrase")
    kept = weakest.join(held, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # First among a share of a language's phrases, then among what is left of all shares.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = grams.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return kept.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
