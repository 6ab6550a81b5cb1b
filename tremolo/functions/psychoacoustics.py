"""Bark bands and masking thresholds, as columns and as arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.functions.dsp import hann_open

#: Exponent of the superposition, tone masking, upper and lower slopes of spreading.
ALPHA = 0.9
TONE = 1 / (10 ** (14.5 / 20) * 10 ** (12 / 20))
UPPER = 1 / 10 ** (7.5 / 20)
LOWER = 1 / 10 ** (26 / 20)


def hz_to_bark(f: Column) -> Column:
    return F.lit(6.0) * F.asinh(f / F.lit(600.0))


def bark_to_hz(b: Column) -> Column:
    return F.lit(650.0) * F.sinh(b / F.lit(7.0))


def band_of_bin(k: Column, size: int, rate: int, bands: int) -> Column:
    """Band of an FFT bin: its Bark value in steps, rounded half to even."""
    step = 6 * np.arcsinh(rate / 2 / 600) / (bands - 1)
    return F.rint(hz_to_bark(k * F.lit(rate / size)) / F.lit(float(step))).cast("int")


def hearing_limit(b: Column) -> Column:
    """Absolute threshold (dB) one Bark above b."""
    f = bark_to_hz(b + 1) / 1000
    return 3.64 * F.pow(f, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * (f - 3.3) * (f - 3.3)) + 1e-3 * F.pow(f, F.lit(4.0))


def masking(levels: Column, bands: int) -> Column:
    """Masking threshold of each band from an array of band magnitudes, the own band left out."""
    from tremolo.functions.arrays import positions

    def part(x, m, n):
        slope = F.when(m < n, F.pow(F.lit(UPPER), (n - m).cast("double"))).otherwise(F.pow(F.lit(LOWER), (m - n).cast("double")))
        return F.when(m == n, F.lit(0.0)).otherwise(F.pow(x * F.lit(TONE) * slope, F.lit(ALPHA)))

    def of(n):
        return F.pow(F.aggregate(F.transform(levels, lambda x, m: part(x, m, n)), F.lit(0.0), lambda s, v: s + v), F.lit(1 / ALPHA))

    return F.transform(positions(F.lit(bands)), of)


#: Lowest and highest edge (Hz) and width (Bark) of the fractional bands, by the published rule of quarter Bark.
LOWEST, HIGHEST, WIDE, SCALE = 80.0, 18000.0, 0.25, 650.0


def fractional_bands() -> list[tuple[int, float, float]]:
    """(band, low, high) in Hz of the 109 bands of a quarter Bark each, the last cut at the highest edge."""
    z = [7 * float(np.arcsinh(f / SCALE)) for f in (LOWEST, HIGHEST)]
    n = int(np.ceil((z[1] - z[0]) / WIDE))
    edge = [SCALE * float(np.sinh((z[0] + k * WIDE) / 7)) for k in range(n)] + [HIGHEST]
    return [(k, edge[k], edge[k + 1]) for k in range(n)]


def fractional_bank(size: int, rate: int) -> np.ndarray:
    """Share of each bin (columns) of a half spectrum that lies in each of the fractional bands."""
    low, high = np.array([b[1:] for b in fractional_bands()]).T[:, :, None]
    k, step = np.arange(size // 2 + 1), rate / size
    return np.maximum(np.minimum(high, (k + 0.5) * step) - np.maximum(low, (k - 0.5) * step), 0) / step


class MaskingModel:
    """The same over arrays of half spectra (rows), for block distances; fractional: over the 109 bands."""

    def __init__(self, size: int, rate: int, bands: int = 24, fractional: bool = False):
        k = np.arange(size // 2 + 1)
        if fractional:
            self.bank = fractional_bank(size, rate)
            bands = len(self.bank)
        else:
            step = 6 * np.arcsinh(rate / 2 / 600) / (bands - 1)
            band = np.rint(6 * np.arcsinh(k * rate / size / 600) / step)
            self.bank = (band == np.arange(bands)[:, None]).astype(float)
        held = self.bank.sum(axis=1)
        self.back = self.bank / np.sqrt(np.where(held > 0, held, 1))[:, None]
        gap = np.arange(bands)[:, None] - np.arange(bands)
        spread = TONE * np.where(gap > 0, UPPER ** np.abs(gap), LOWER ** np.abs(gap))
        self.spread = np.where(gap == 0, 0.0, spread**ALPHA)

    def threshold(self, magnitudes: np.ndarray) -> np.ndarray:
        levels = np.atleast_2d(magnitudes) @ self.bank.T
        return (levels**ALPHA @ self.spread.T) ** (1 / ALPHA) @ self.back


# The way through the outer and middle ear

#: Hz, and at these the level in dB of equal loudness at 60 dB (ELC) and of the minimum audible
#: field (MAF); then Hz and dB of the minimum audible pressure (MAP).
FIELD_HZ = [
    20, 25, 30, 35, 40, 45, 50, 55, 60, 70, 80, 90, 100, 125, 150, 177, 200, 250, 300, 350, 400, 450, 500, 550, 600, 700, 800, 900, 1000, 1500,
    2000, 2500, 2828, 3000, 3500, 4000, 4500, 5000, 5500, 6000, 7000, 8000, 9000, 10000, 12748, 15000,
]
ELC = [
    31.8, 26.0, 21.7, 18.8, 17.2, 15.4, 14.0, 12.6, 11.6, 10.6, 9.2, 8.2, 7.7, 6.7, 5.3, 4.6, 3.9, 2.9, 2.7, 2.3, 2.2, 2.3, 2.5, 2.7, 2.9, 3.4, 3.9, 3.9, 3.9, 2.7,
    0.9, -1.3, -2.5, -3.2, -4.4, -4.1, -2.5, -0.5, 2.0, 5.0, 10.2, 15.0, 17.0, 15.5, 11.0, 22.0,
]
MAF = [
    73.4, 65.2, 57.9, 52.7, 48.0, 45.0, 41.9, 39.3, 36.8, 33.0, 29.7, 27.1, 25.0, 22.0, 18.2, 16.0, 14.0, 11.4, 9.2, 8.0, 6.9, 6.2, 5.7, 5.1, 5.0, 5.0, 4.4, 4.3, 3.9, 2.7,
    0.9, -1.3, -2.5, -3.2, -4.4, -4.1, -2.5, -0.5, 2.0, 5.0, 10.2, 15.0, 17.0, 15.5, 11.0, 22.0,
]
PRESSURE_HZ = [125, 250, 500, 1000, 1500, 2000, 3000, 4000, 6000, 8000, 10000, 12000, 14000, 16000]
MAP = [30.0, 19.0, 12.0, 9.0, 11.0, 16.0, 16.0, 14.0, 14.0, 9.9, 24.7, 32.7, 44.1, 63.7]
CURVES = {"ELC": (FIELD_HZ, ELC), "MAF": (FIELD_HZ, MAF), "MAP": (PRESSURE_HZ, MAP)}


def ear_level(hz: np.ndarray, curve: str = "ELC") -> np.ndarray:
    """The curve's level (dB) by the natural cubic spline through its points; beyond them that of the nearest point."""
    if curve not in CURVES:
        raise ValueError(f"no such curve: {curve}")
    x, y = (np.array(v, float) for v in CURVES[curve])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    bend = np.zeros(len(x))  # second derivatives, none at the ends
    system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    bend[1:-1] = np.linalg.solve(system, 6 * np.diff(slope))
    at = np.clip(np.asarray(hz, float), x[0], x[-1])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    a, b = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * bend[i] + (b**3 - b) * bend[i + 1]) * h[i] ** 2 / 6


@lru_cache(maxsize=16)
def ear_taps(taps: int, rate: int, curve: str = "ELC") -> np.ndarray:
    """A linear-phase filter of so many taps (even) whose gain is the curve's, by frequency sampling and a Hamming window.

    The gain is ten to minus a tenth of the level, as published; half the rate gets none.
    """
    if taps < 2 or taps % 2:
        raise ValueError("the number of taps must be even")
    n = 2 ** int(np.ceil(np.log2(taps)))
    gain = 10 ** (-ear_level(np.arange(n + 1) * rate / (2 * n), curve) / 10)
    gain[n] = 0
    turned = gain * np.exp(-0.5j * np.pi * (taps - 1) * np.arange(n + 1) / n)
    return np.fft.irfft(turned)[:taps] * np.hamming(taps)


@lru_cache(maxsize=16)
def ear_weights(size: int, rate: int, curve: str = "ELC") -> np.ndarray:
    """Gain of that filter at each bin of a half spectrum of size points, the largest taken as 1."""
    gain = np.abs(np.fft.rfft(ear_taps(size, rate, curve)))
    return gain / gain.max()


def noise_to_mask(x: np.ndarray, y: np.ndarray, rate: int, size: int = 1024, hop: int = 256, curve: str = "ELC", fractional: bool = True) -> float | None:
    """Masked error (dB) of y, taken over the length of the shorter of both, against x.

    The squared difference of magnitudes, weighed by the ear, over the masking threshold of x, summed over the
    bins, averaged over blocks and divided by the number of bands. Bins that no band holds have no threshold and
    don't count. None without samples or without any difference.
    """
    n = min(len(x), len(y))
    if not n:
        return None
    model, ear, w = MaskingModel(size, rate, fractional=fractional), ear_weights(size, rate, curve), hann_open(size)
    held = model.bank.any(axis=0)
    count = max(0, -(-(n - size) // hop)) + 1
    x, y = (np.pad(np.asarray(v, float)[:n], (0, max(0, (count - 1) * hop + size - n))) for v in (x, y))
    error = 0.0
    for m in range(0, count, 256):  # memory of so many blocks at a time
        at = np.arange(m, min(m + 256, count))[:, None] * hop + np.arange(size)
        a, b = (np.abs(np.fft.rfft(v[at] * w, axis=1)) for v in (x, y))
        error += float(((a - b) ** 2 * ear / (model.threshold(a) + np.finfo(float).eps))[:, held].sum())
    return 10 * float(np.log10(error / count / len(model.bank))) if error > 0 else None
