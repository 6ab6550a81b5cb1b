"""Array kernels shared by the text operators: words, hashes and slices of Arrow text.

Texts arrive as Arrow string columns. Their bytes are used in place: a word is a run
of bytes of one class, its hash comes from one running sum over the bytes, and nothing
is turned into Python strings on the hot path. Work goes in slices that stay in a core's cache,
so a task needs memory for one slice, or for one text if that is longer.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
U64 = np.uint64

_GOLD = U64(0x9E3779B97F4A7C15)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)
_STEP = U64(0xD6E8FEB86659FD93)
_STEP_INV = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    x = x + _GOLD
    y = x >> U64(30)
    x ^= y
    x *= _M1
    np.right_shift(x, U64(27), out=y)
    x ^= y
    x *= _M2
    np.right_shift(x, U64(31), out=y)
    x ^= y
    return x


_BYTE_CODE = mix(np.arange(256, dtype=U64))

#: ASCII white space as the contracts have it: blank and \x09 to \x0D.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a to z, and all of non-ASCII text.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def releases(f: Callable) -> Callable:
    """A generator over batches that gives its memory back when it ends: Python workers are used again."""

    @wraps(f)
    def run(*args, **named):
        try:
            yield from f(*args, **named)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


class Text(NamedTuple):
    """Texts i = data[offsets[i]:offsets[i + 1]]; null texts are empty and not valid."""

    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.valid)

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_of(column) -> Text:
    """The bytes of an Arrow string column, without a copy where it can be."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    valid = ~np.asarray(column.is_null()) if column.null_count else np.ones(n, bool)
    _, offs, data = column.buffers()
    if n == 0 or data is None:
        return Text(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid)
    offs = np.frombuffer(offs, np.int64, n + 1, at * 8)
    return Text(np.frombuffer(data, np.uint8), offs, valid)


def slices(t: Text, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """Consecutive ranges (first, last) of texts with about most bytes, rebased to 0."""
    i, n = 0, len(t)
    while i < n:
        j = int(np.searchsorted(t.offsets, t.offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        a, b = t.offsets[i], t.offsets[j]
        yield i, j, Text(t.data[a:b], t.offsets[i : j + 1] - a, t.valid[i:j])
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, other bytes as they are."""
    return _LOWER[data]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags; a run ends where its text does."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head, tail = offsets[:-1], offsets[1:]
    real = tail > head
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[head[real]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[tail[real] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        up = np.full(m, _STEP, U64)
        down = np.full(m, _STEP_INV, U64)
        up[0] = down[0] = 1
        if m > 64 * SLICE_BYTES:  # one very long text: not kept
            return np.cumprod(up), np.cumprod(down)
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def running(data: np.ndarray) -> np.ndarray:
    """Running sum of byte codes by position, for hash_spans."""
    out = np.zeros(len(data) + 1, U64)
    codes = _BYTE_CODE[data]
    codes *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(codes, out=out[1:])
    return out


def hash_spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes wherever they stand."""
    raw = total[ends] - total[starts]
    raw *= powers(len(total))[1][starts]
    raw ^= (ends - starts).astype(U64) * _M2
    return mix(raw)


class Words(NamedTuple):
    """Word k spans starts[k]:ends[k]; text i has words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words_of(t: Text, data: np.ndarray, inside: np.ndarray, hashed: bool = True) -> Words:
    """Words of a slice; data is t.data, or what it became in lower case."""
    starts, ends = runs(inside, t.offsets)
    first = np.searchsorted(starts, t.offsets)
    h = hash_spans(running(data), starts, ends) if hashed and len(starts) else np.zeros(len(starts), U64)
    return Words(starts, ends, first, h)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words from each position; the last n - 1 are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = hashes[:m].copy()
    for k in range(1, n):
        h *= _STEP
        h += hashes[k : k + m]
    return mix(h)


def word_hash(*words: str) -> np.ndarray:
    """Hashes of given words, as words_of would have them."""
    out = []
    for w in words:
        d = np.frombuffer(w.encode(), np.uint8)
        out.append(hash_spans(running(d), np.array([0]), np.array([len(d)]))[0])
    return np.array(out, U64)


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def crc32_mod(column, n: int):
    """crc32 of an id as text, modulo n, as a Spark column; null ids count as empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
