"""Signal kernels in NumPy: filter design, recursive and FIR filters, transforms, stretching."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Butterworth design: analog prototype, frequency transform, bilinear transform


def butter(order: int, cutoff, kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain; cutoff relative to half the sampling rate, a pair for bandstop."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    rate = 2.0
    warped = 2 * rate * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / rate)
    if kind == "lowpass":
        zeros, poles = np.zeros(0, complex), warped[0] * poles
    elif kind == "highpass":
        zeros, poles = np.zeros(order, complex), warped[0] / poles
    elif kind == "bandstop":
        width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = width / 2 / poles
        root = np.sqrt(half**2 - centre**2)
        zeros = np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)])
        poles = np.concatenate([half + root, half - root])
    else:
        raise ValueError(f"unknown kind of filter: {kind}")
    z = (2 * rate + zeros) / (2 * rate - zeros)
    p = (2 * rate + poles) / (2 * rate - poles)
    z = np.concatenate([z, -np.ones(len(p) - len(z))])
    one = -1.0 if kind == "highpass" else 1.0  # where the gain is 1
    gain = 1 / np.real(np.prod(one - z) / np.prod(one - p))
    return z, p, float(gain)


def polynomials(zpk) -> tuple[np.ndarray, np.ndarray]:
    z, p, k = zpk
    return np.real(k * np.poly(z)), np.real(np.poly(p))


def sections(zpk) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections: each pole pair with the nearest zeros; the gain is in the first."""
    z, p, k = list(zpk[0]), list(zpk[1]), zpk[2]

    def pull(pool: list, x: complex) -> list:
        i = int(np.argmin(np.abs(np.array(pool) - x)))
        got = [pool.pop(i)]
        if abs(got[0].imag) > 1e-9:
            j = int(np.argmin(np.abs(np.array(pool) - np.conj(got[0]))))
            got.append(pool.pop(j))
        elif pool:
            real = [i for i, q in enumerate(pool) if abs(q.imag) <= 1e-9]
            if real:
                got.append(pool.pop(min(real, key=lambda i: abs(pool[i] - x))))
        return got

    out = []
    while p:
        pole = max(p, key=abs)
        poles = pull(p, pole)
        zeros = pull(z, pole) if z else []
        while len(zeros) > len(poles):
            z.append(zeros.pop())
        out.append([np.real(np.poly(zeros)) if zeros else np.ones(1), np.real(np.poly(poles))])
    out[0][0] = out[0][0] * k
    return [(b, a) for b, a in out]


def response(b: np.ndarray, a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Frequency response at angular frequencies w."""
    e = np.exp(-1j * w)
    return np.polyval(b[::-1], e) / np.polyval(a[::-1], e)


#: Samples that a filter takes at once.
BLOCK = 64


class Blocked(NamedTuple):
    """A filter over BLOCK samples as matrices: outputs from samples and state, the next state from both."""

    through: np.ndarray
    seen: np.ndarray
    feed: np.ndarray
    power: np.ndarray
    calm: bool


#: Over this largest entry of the powers of its step, composed states of a filter cancel too many digits.
CALM = 1e3


@lru_cache(256)
def _blocked(b: tuple, a: tuple, size: int) -> Blocked:
    """Direct form II transposed: s' = A s + B x, y = s_0 + b_0 x, run over size unit impulses and states."""
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0] = -np.array(a[1:])
    step[:-1, 1:] += np.eye(n - 1)
    into = np.array(b[1:]) - np.array(a[1:]) * b[0]
    powers = [np.eye(n)]
    while len(powers) <= size:
        powers.append(step @ powers[-1])
    seen = np.array([p[0] for p in powers[:size]])
    response = np.concatenate([[b[0]], seen[: size - 1] @ into])
    gap = np.arange(size)[:, None] - np.arange(size)
    through = np.where(gap >= 0, response[np.maximum(gap, 0)], 0.0)
    feed = np.stack([powers[size - 1 - k] @ into for k in range(size)], axis=1)
    return Blocked(through, seen, feed, powers[size], bool(np.abs(powers).max() <= CALM))


def blocked(b, a, size: int = BLOCK) -> Blocked:
    b, a = np.atleast_1d(np.asarray(b, float)) / a[0], np.atleast_1d(np.asarray(a, float)) / a[0]
    n = max(len(b), len(a), 2)
    return _blocked(tuple(np.pad(b, (0, n - len(b)))), tuple(np.pad(a, (0, n - len(a)))), size)


def carried(fed: np.ndarray, power: np.ndarray, first: np.ndarray) -> np.ndarray:
    """States before each block and after the last, fed[:, k] being what block k adds: a prefix composition by doubling."""
    s = np.concatenate([first[:, None], fed], axis=1)
    gap = 1
    while gap < s.shape[1]:
        s[:, gap:] = s[:, gap:] + s[:, :-gap] @ power.T
        power, gap = power @ power, 2 * gap
    return s


def iir_with_state(b, a, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered rows, and their states at the end, by blocks of samples.

    Filters of high order whose poles crowd near 1 aren't calm and go sample by sample; as a cascade of
    second-order sections they are.
    """
    m, x = blocked(b, a), np.atleast_2d(np.asarray(x, float))
    rows, n = x.shape
    count, order = -(-n // BLOCK), m.power.shape[0]
    first = np.zeros((rows, order)) if state is None else np.atleast_2d(np.asarray(state, float))
    first = np.pad(first, ((0, 0), (0, order - first.shape[1])))
    if not m.calm:
        one, y = blocked(b, a, 1), np.empty_like(x)
        for i in range(n):
            y[:, i] = one.through[0, 0] * x[:, i] + first[:, 0]
            first = first @ one.power.T + x[:, i : i + 1] * one.feed[:, 0]
        return y, first
    whole = n // BLOCK
    cut = x[:, : whole * BLOCK].reshape(rows, whole, BLOCK)
    s = carried(cut @ m.feed.T, m.power, first)
    y = (cut @ m.through.T + s[:, :-1] @ m.seen.T).reshape(rows, -1)
    last = s[:, -1]
    if count > whole:
        rest = x[:, whole * BLOCK :]
        k = rest.shape[1]
        y = np.concatenate([y, rest @ m.through[:k, :k].T + last @ m.seen[:k].T], axis=1)
        e = blocked(b, a, k)
        last = rest @ e.feed.T + last @ e.power.T
    return y, last


def iir(b, a, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Direct form II transposed along the last axis; rows are separate signals."""
    return iir_with_state(b, a, x, state)[0]


def cascade(parts: list, x: np.ndarray) -> np.ndarray:
    """Sections one after the other, each by blocks of samples; rows are separate signals."""
    for b, a in parts:
        x = iir(b, a, x)
    return np.atleast_2d(x)


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state in which a constant 1 passes unchanged but for the gain at 0."""
    n = max(len(b), len(a))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    companion = np.zeros((n - 1, n - 1))
    companion[0] = -a[1:]
    companion[1:, :-1] = np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - companion.T, b[1:] - a[1:] * b[0])


def in_slices(x: np.ndarray, size: int, overlap: int, ask: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Answers to overlapping slices of x, joined; every slice but the first begins with the end of the answer before.

    The carried samples are scaled so that their largest value is that of what they replace, unless theirs is 0;
    ask(slice, number of carried samples) answers with as many samples as it got. x shorter than a stride is one slice.
    """
    if not 0 < overlap <= size // 2:
        raise ValueError("overlap must be positive and at most half of a slice")
    stride, out, last = min(size - overlap, len(x)), [], None
    for k in range(len(x) // stride if stride else 0):
        part = np.array(x[k * stride : k * stride + size], float)
        kept = 0
        if last is not None:
            tail, kept = last[-overlap:], overlap
            peak = tail.max()
            part[:overlap] = tail * (part[:overlap].max() / peak if peak != 0 else 1.0)
        last = np.asarray(ask(part, kept), float)
        if len(last) != len(part):
            raise ValueError(f"{len(part)} samples were sent, {len(last)} came back")
        out.append(last[kept:])
    return np.concatenate(out) if out else np.zeros(0)


def in_range_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y scaled and shifted to the least and largest value of x; as it is where either is empty or y is flat."""
    if not len(x) or not len(y) or y.max() == y.min():
        return y
    return (y - y.min()) / (y.max() - y.min()) * (x.max() - x.min()) + x.min()


def zero_phase(parts: list, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward through second-order sections, with odd extension; rows are separate signals."""
    x = np.atleast_2d(np.asarray(x, float))
    pad = min(pad, x.shape[1] - 1)
    first, last = x[:, :1], x[:, -1:]
    y = np.hstack([2 * first - x[:, pad:0:-1], x, 2 * last - x[:, -2 : -pad - 2 : -1]]) if pad > 0 else x
    for _ in range(2):
        level = y[:, :1]
        for b, a in parts:
            y = iir(b, a, y, level * steady_state(b, a))
            level = level * (b.sum() / a.sum())
        y = y[:, ::-1]
    return y[:, pad : y.shape[1] - pad] if pad > 0 else y


# Linear prediction


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Coefficients 1, a1, ... of the autoregressive model by Burg's recursion."""
    f, b, a = x[1:].astype(float), x[:-1].astype(float), np.ones(1)
    power = (f @ f) + (b @ b)
    for _ in range(order):
        k = -2 * (f @ b) / (power + np.finfo(float).tiny) if len(f) else 0.0
        a = np.append(a, 0.0) + k * np.append(a, 0.0)[::-1]
        f, b = f + k * b, b + k * f
        if len(f):
            power = (1 - k * k) * power - b[-1] ** 2 - f[0] ** 2
        f, b = f[1:], b[:-1]
    return a


def predict(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each sample from those before it."""
    return np.convolve(x, np.append(0.0, -a[1:]))[: len(x)]


# Changing the rate


def _sinc_window(half: int, cutoff: float, window: np.ndarray) -> np.ndarray:
    h = cutoff * np.sinc(cutoff * np.arange(-half, half + 1)) * window
    return h / h.sum()


def decimation_taps(q: int) -> np.ndarray:
    return _sinc_window(10 * q, 1 / q, np.hamming(20 * q + 1))


@lru_cache(64)
def resampling_taps(up: int, down: int) -> np.ndarray:
    wide = max(up, down)
    return up * _sinc_window(10 * wide, 1 / wide, np.kaiser(20 * wide + 1, 5.0))


#: Numbers that resampling holds at once beside its input and output, and those of a kept matrix of taps.
RESAMPLED_AT_ONCE, KEPT_TAPS = 1 << 19, 1 << 20


@lru_cache(32)
def _bank(up: int, down: int, taps: bytes) -> tuple[int, np.ndarray]:
    """Output q up + r is x[q down + first :] @ matrix[:, r]: the first place, which can be before x, and the matrix."""
    h = np.frombuffer(taps)
    place = np.arange(up) * down + len(h) // 2
    start, tap = place // up, place % up
    count = (len(h) - 1) // up + 1
    first = int(start[0]) - count + 1
    matrix = np.zeros((int(start[-1]) - first + 1, up))
    for j in range(count):
        own = np.flatnonzero(tap + j * up < len(h))
        matrix[start[own] - j - first, own] = h[tap[own] + j * up]
    return first, matrix


def poly_resample(x: np.ndarray, up: int, down: int, taps: np.ndarray | None = None) -> np.ndarray:
    """Zero-phase polyphase resampling to ceil(N up / down) samples.

    The taps that outputs meet repeat every `up` of them, so that many come from one product with a matrix. Ratios
    whose matrix would be large, and clips with samples that aren't finite, go tap by tap. Either way in parts.
    """
    g = math.gcd(up, down)
    up, down = up // g, down // g
    x = np.asarray(x, float)
    if up == down == 1 and taps is None:
        return x.copy()
    h = np.asarray(resampling_taps(up, down) if taps is None else taps, float)
    n_out, count = -(-len(x) * up // down), (len(h) - 1) // up + 1
    if (down + count) * up > KEPT_TAPS or not np.isfinite(x).all():
        out, size = np.empty(n_out), max(1, RESAMPLED_AT_ONCE // count)
        for i in range(0, n_out, size):
            # of all taps only every up-th meets a sample
            place = np.arange(i, min(i + size, n_out))[:, None] * down + len(h) // 2
            k = place // up - np.arange(count)
            tap = place - k * up
            ok = (k >= 0) & (k < len(x)) & (tap < len(h))
            out[i : i + size] = np.where(ok, x[np.clip(k, 0, len(x) - 1)] * h[np.minimum(tap, len(h) - 1)], 0.0).sum(axis=1)
        return out
    first, matrix = _bank(up, down, h.tobytes())
    rows, width = -(-n_out // up), len(matrix)
    ahead = max(0, -first)
    y = np.pad(x, (ahead, max(0, (rows - 1) * down + first + width - len(x))))
    parts = np.lib.stride_tricks.sliding_window_view(y[ahead + first :], width)[::down][:rows] if rows else np.zeros((0, width))
    out, size = np.empty((rows, up)), max(1, RESAMPLED_AT_ONCE // width)
    for i in range(0, rows, size):
        np.matmul(np.ascontiguousarray(parts[i : i + size]), matrix, out=out[i : i + size])
    return out.ravel()[:n_out]


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    return poly_resample(x, to, rate)


# Frames and spectra


def hann_open(n: int) -> np.ndarray:
    """A Hann window of n + 2 points without its zero ends."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, n + 1) / (n + 1))


def _padded(x: np.ndarray, before: int, after: int) -> np.ndarray:
    return np.pad(x, [(0, 0)] * (x.ndim - 1) + [(before, after)])


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """One-sided spectra (frames by rows, of each signal along the last axis) with a periodic Hann window, zeros around the signal."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    y = _padded(np.asarray(x), size // 2, size // 2)
    y = _padded(y, 0, (-(y.shape[-1] - size)) % hop)
    at = np.arange(0, y.shape[-1] - size + 1, hop)[:, None] + np.arange(size)
    return np.fft.rfft(y[..., at] * w, axis=-1) / w.sum()


def istft(s: np.ndarray, size: int, hop: int) -> np.ndarray:
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    frames = np.fft.irfft(s * w.sum(), size, axis=-1) * w
    n = (s.shape[-2] - 1) * hop + size
    y, norm = np.zeros((*s.shape[:-2], n)), np.zeros(n)
    for m in range(s.shape[-2]):
        y[..., m * hop : m * hop + size] += frames[..., m, :]
        norm[m * hop : m * hop + size] += w * w
    return (y / np.where(norm > 1e-10, norm, 1.0))[..., size // 2 : n - size // 2]


def synthesis_window(window: np.ndarray, hop: int) -> np.ndarray:
    """The window with which overlap-adding frames cut by `window` gives the signal nearest to them in least squares.

    Any hop up to the window's length, dividing it or not; places where every shifted window is 0 stay 0.
    """
    window = np.asarray(window, float)
    if not 0 < hop <= len(window):
        raise ValueError("hop must be from 1 to the window's length")
    energy = np.bincount(np.arange(len(window)) % hop, window**2, hop)[np.arange(len(window)) % hop]
    return np.divide(window, energy, out=np.zeros_like(window), where=energy > 0)


def quantize_spectrum(x: np.ndarray, size: int, hop: int, levels: int) -> np.ndarray:
    s = stft(x, size, hop)
    m, low, high = np.abs(s), np.abs(s).min(), np.abs(s).max()
    steps = np.rint((m - low) / (high - low + 1e-8) * (levels - 1)) / (levels - 1)
    return istft((steps * (high - low) + low) * np.exp(1j * np.angle(s)), size, hop)


def stretch(x: np.ndarray, factor: float, size: int = 2048) -> np.ndarray:
    """Phase vocoder along the last axis: a factor over 1 makes the signal longer, at the same pitch."""
    hop, n_out = size // 4, int(round(x.shape[-1] * factor))
    s = np.swapaxes(stft(x, size, hop), -1, -2)
    steps = np.arange(0, s.shape[-1], 1 / factor)
    s = _padded(s, 0, 2)
    level, angle = np.abs(s), np.angle(s)
    advance = 2 * np.pi * hop * np.arange(s.shape[-2]) / size
    phase, out = angle[..., 0], np.empty((*s.shape[:-1], len(steps)), complex)
    for k, t in enumerate(steps):
        i, part = int(t), t - int(t)
        out[..., k] = ((1 - part) * level[..., i] + part * level[..., i + 1]) * np.exp(1j * phase)
        turn = angle[..., i + 1] - angle[..., i] - advance
        phase = phase + advance + turn - 2 * np.pi * np.rint(turn / (2 * np.pi))
    y = istft(np.swapaxes(out, -1, -2), size, hop)
    return _padded(y, 0, max(0, n_out - y.shape[-1]))[..., :n_out]


def shift_pitch(x: np.ndarray, semitones: float, size: int = 2048) -> np.ndarray:
    """Stretched, then read at another speed by linear interpolation to the old length."""
    ratio = 2 ** (semitones / 12)
    y, n = stretch(x, ratio, size), x.shape[-1]
    if not y.shape[-1]:
        return np.array(x, float)
    rows = [np.interp(np.arange(n) * ratio, np.arange(y.shape[-1]), v) for v in y.reshape(-1, y.shape[-1])]
    return np.array(rows).reshape(x.shape)


# Wavelets

#: Orthogonal scaling filters by name.
SCALING = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db1": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314453414, 0.8365163037378079, 0.2241438680420134, -0.12940952255126037],
}


def wavelet_denoise(x: np.ndarray, wavelet: str = "db1", mode: str = "soft", factor: float = 0.5) -> np.ndarray:
    """Universal threshold on every band of a full-depth periodic transform; odd lengths grow by one."""
    if wavelet not in SCALING:
        raise ValueError(f"unknown wavelet: {wavelet}")
    if mode not in ("soft", "hard"):
        raise ValueError(f"unknown threshold mode: {mode}")
    h = np.array(SCALING[wavelet])
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    bands, a, lengths = [], np.asarray(x, float), []
    depth = int(math.log2(len(x) / (len(h) - 1))) if len(x) >= len(h) else 0
    for _ in range(depth):
        lengths.append(len(a))
        if len(a) % 2:
            a = np.append(a, a[-1])
        idx = (np.arange(0, len(a), 2)[:, None] + np.arange(len(h))) % len(a)
        bands.append(a[idx] @ g)
        a = a[idx] @ h
    if not bands:
        return a
    limit = np.median(np.abs(bands[0])) / 0.6745 * math.sqrt(2 * math.log(len(x))) * factor

    def cut(c):
        return np.sign(c) * np.maximum(np.abs(c) - limit, 0) if mode == "soft" else np.where(np.abs(c) < limit, 0.0, c)

    a = cut(a)
    for d in range(depth - 1, -1, -1):
        c, n = cut(bands[d]), 2 * len(bands[d])
        idx = (np.arange(0, n, 2)[:, None] + np.arange(len(h))) % n
        out = np.zeros(n)
        np.add.at(out, idx, a[:, None] * h + c[:, None] * g)
        a = out if d == 0 else out[: lengths[d]]
    return a


# Block replacement


def fit_blocks(blocks: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Least-squares fits of blocks (n, size) from their near ones (n, k, size), the shortest solution where these depend on each other.

    Spectra of real blocks have real inner products, so that the fit of the blocks is that of their spectra.
    """
    basis = np.swapaxes(near, 1, 2)
    solved = np.linalg.pinv(basis, rcond=np.finfo(float).eps * max(basis.shape[1:])) @ blocks[:, :, None]
    return (basis @ solved)[:, :, 0]


def replace_blocks(x: np.ndarray, size: int, hop: int, upper: float, k: int, model=None) -> np.ndarray:
    """Each windowed spectrum by its least-squares fit from the first k near blocks outside its own neighbourhood."""
    n, count = len(x), max(0, -(-(len(x) - size) // hop)) + 1
    w = hann_open(size)
    y = np.pad(x, (0, count * hop + size - n))
    s = np.fft.fft(y[np.arange(count)[:, None] * hop + np.arange(size)] * w, axis=1)
    m = np.abs(s) if model is None else np.abs(s[:, : size // 2 + 1])
    limits = None if model is None else model.threshold(m)

    def distances(one, one_limit, many, many_limit):
        if model is None:
            return np.linalg.norm(one - many, axis=-1)
        return np.linalg.norm(one * (one > one_limit) - many * (many > np.maximum(one_limit, many_limit)), axis=-1)

    out, chosen, best, places = s.copy(), {}, np.full(count, np.inf), np.arange(count)
    part = max(1, (1 << 17) // m.size)
    for a in range(0, count, part):
        own = slice(a, a + part)
        d = distances(m[own, None], None if limits is None else limits[own, None], m, limits)
        far = np.abs(places[own, None] - places) > size // hop
        fits = far & (d <= upper)
        least = np.where(far, d, np.inf).min(axis=1)
        for i in np.flatnonzero(fits.any(axis=1)):
            near = np.flatnonzero(fits[i])[:k]
            chosen.setdefault(len(near), []).append((a + i, near))
            best[a + i] = least[i]
    windowed = y[np.arange(count)[:, None] * hop + np.arange(size)] * w
    for found in chosen.values():
        at = np.array([i for i, _ in found])
        for part in range(0, len(found), 64):
            own = at[part : part + 64]
            fit = np.fft.fft(fit_blocks(windowed[own], windowed[np.array([near for _, near in found[part : part + 64]])]), axis=1)
            g = np.abs(fit)[:, : m.shape[1]]
            kept = distances(m[own], None if limits is None else limits[own], g, None if limits is None else model.threshold(g)) <= best[own]
            out[own[kept]] = fit[kept]
    total, norm = np.zeros((count - 1) * hop + size), np.zeros((count - 1) * hop + size)
    for i, block in enumerate(np.real(np.fft.ifft(out, axis=1)) * w):
        total[i * hop : i * hop + size] += block
        norm[i * hop : i * hop + size] += w * w
    return (total / norm)[:n]


# Short-time objective intelligibility (Taal, Hendriks, Heusdens and Jensen, 2011)


@lru_cache(1)
def _stoi_parts() -> tuple[np.ndarray, np.ndarray]:
    """Window of 256 samples at 10 kHz, and the share of each of the 257 bins in the 15 bands."""
    freq = np.linspace(0, 5000, 257)
    centre = 150 * 2.0 ** (np.arange(15) / 3)
    return hann_open(256), ((freq >= centre[:, None] * 2 ** (-1 / 6)) & (freq < centre[:, None] * 2 ** (1 / 6))).T.astype(float)


def stoi(clean: np.ndarray, degraded: np.ndarray, rate: int) -> float | None:
    """Mean correlation of one-third octave envelopes over 30 frames at 10 kHz; None if too short.

    Frames, and the spans of 30 of them, are taken some hundreds at a time.
    """
    x, y = (resample(np.asarray(v, float), rate, 10000) for v in (clean, degraded))
    size, hop, fft, span, many = 256, 128, 512, 30, 512
    n = min(len(x), len(y))
    if n < size:
        return None
    w, bands = _stoi_parts()
    fx, fy = (np.lib.stride_tricks.sliding_window_view(v[:n], size)[::hop] for v in (x, y))
    level = np.concatenate([20 * np.log10(np.linalg.norm(fx[i : i + many] * w, axis=1) + np.finfo(float).eps) for i in range(0, len(fx), many)])
    loud = np.flatnonzero(level > level.max() - 40)
    if len(loud) < span:
        return None
    bx, by = (np.concatenate([np.sqrt(np.abs(np.fft.rfft(f[loud[i : i + many]] * w, fft, axis=1)) ** 2 @ bands) for i in range(0, len(loud), many)]) for f in (fx, fy))
    spans_x, spans_y = (np.lib.stride_tricks.sliding_window_view(v, span, axis=0) for v in (bx, by))
    total, norm = 0.0, lambda v: np.sqrt((v * v).sum(axis=2, keepdims=True))
    for m in range(0, len(spans_x), many):
        a, b = spans_x[m : m + many], spans_y[m : m + many]
        b = np.minimum(b * (norm(a) / (norm(b) + 1e-15)), a * (1 + 10 ** (15 / 20)))
        a, b = a - a.mean(axis=2, keepdims=True), b - b.mean(axis=2, keepdims=True)
        total += ((a * b).sum(axis=2, keepdims=True) / (norm(a) * norm(b) + 1e-15)).mean(axis=1).sum()
    return float(total / len(spans_x))
