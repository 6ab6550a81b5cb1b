"""Attacks that need a recursion or a transform: NumPy on Arrow batches.

Clips of one rate and of similar lengths are stacked, so a recursive filter runs over all of
them at once (one that runs backward too needs equal lengths), and filters are designed once
for each rate.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.functions import dsp
from tremolo.functions.rng import normals_of
from tremolo.operators.attacks import check
from tremolo.operators.catalog import Clip, register_attack


def stacked(audio: pd.Series, rates: pd.Series, run, causal: bool = False) -> pd.Series:
    """run(rows, rate) for each group of one length and rate; nulls and empty clips stay.

    A causal run takes lengths within a factor of two together, zeros behind the shorter
    clips, and what it gives for those is cut off.
    """
    groups: dict[tuple, list[int]] = {}
    for i, (a, r) in enumerate(zip(audio, rates)):
        if a is not None and len(a):
            groups.setdefault((len(a).bit_length() if causal else len(a), r), []).append(i)
    out: list = list(audio)
    for (_, r), rows in groups.items():
        lengths = [len(audio.iloc[i]) for i in rows]
        many = np.zeros((len(rows), max(lengths)))
        for k, i in enumerate(rows):
            many[k, : lengths[k]] = audio.iloc[i]
        for i, n, y in zip(rows, lengths, run(many, int(r))):
            out[i] = y[:n] if causal else y
    return pd.Series(out, index=audio.index)


def kernel(c: Clip, run, causal: bool = False, finish=None) -> Column:
    """finish: a function of each whole clip after run."""

    @F.pandas_udf("array<double>")
    def go(audio: pd.Series, rate: pd.Series) -> pd.Series:
        out = stacked(audio, rate, run, causal)
        return out if finish is None else out.map(lambda y: y if y is None or not len(y) else finish(y))

    return go(c.audio, c.rate)


def each(c: Clip, run) -> Column:
    return kernel(c, lambda rows, rate: [run(x, rate) for x in rows])


def together(c: Clip, run) -> Column:
    """run(rows) on clips of one length, as many at once as have about 65,536 samples."""

    def go(rows: np.ndarray, rate: int) -> list[np.ndarray]:
        most = max(1, (1 << 16) // rows.shape[1])
        return [y for i in range(0, len(rows), most) for y in run(rows[i : i + most])]

    return kernel(c, go)


@lru_cache(64)
def filter_for(kind: str, cutoff, order: int, rate: int):
    check(all(0 < f < rate / 2 for f in np.atleast_1d(cutoff)), f"cutoff {cutoff} isn't between 0 and {rate / 2}")
    return dsp.butter(order, np.asarray(cutoff) / (rate / 2), kind)


@register_attack("LowpassFilterAttack", "kernel", cutoff_freq_lowpass=5000.0, order=5)
def lowpass(c: Clip, cutoff_freq_lowpass, order) -> Column:
    return kernel(c, lambda x, r: dsp.cascade(dsp.sections(filter_for("lowpass", float(cutoff_freq_lowpass), order, r)), x), causal=True)


@register_attack("HighpassFilterAttack", "kernel", cutoff_freq_highpass=50.0, order=4)
def highpass(c: Clip, cutoff_freq_highpass, order) -> Column:
    return kernel(c, lambda x, r: dsp.cascade(dsp.sections(filter_for("highpass", float(cutoff_freq_highpass), order, r)), x), causal=True)


@register_attack("BandstopFilterAttack", "kernel", freq_range=[200.0, 300.0], order=4)
def bandstop(c: Clip, freq_range, order) -> Column:
    pair = tuple(map(float, freq_range))
    return kernel(c, lambda x, r: dsp.zero_phase(dsp.sections(filter_for("bandstop", pair, order, r)), x, 3 * (2 * order + 1)))


@register_attack("LPCAttack", "kernel", order=12, axis=-1)
def lpc(c: Clip, order, axis) -> Column:
    return each(c, lambda x, r: dsp.predict(x, dsp.burg(x, order)))


#: Centre frequencies and bandwidths of the equalizer's bands in use.
BANDS = [(31.5, 22.0), (63.0, 44.0), (125.0, 88.0), (250.0, 177.0), (500.0, 355.0), (1000.0, 710.0), (2000.0, 1420.0), (4000.0, 2840.0)]


def biquad(kind: str, fc: float, bandwidth: float, gain_db: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """b and a (a0 = 1) after the audio equalizer cookbook, with alpha = sin(w) fc / (2 bandwidth)."""
    check(rate >= 0 and 0 <= fc < rate / 2, f"illegal centre frequency {fc} at rate {rate}")
    w = 2 * np.pi * fc / rate
    cos, alpha, amp = np.cos(w), np.sin(w) * fc / (2 * bandwidth), 10 ** (gain_db / 40)
    plain = [1 + alpha, -2 * cos, 1 - alpha]
    if kind in ("Peaking", "LowShelf", "HighShelf") and amp == 1:
        b, a = [1, 0, 0], [1, 0, 0]
    elif kind == "LowPass":
        b, a = [(1 - cos) / 2, 1 - cos, (1 - cos) / 2], plain
    elif kind == "HighPass":
        b, a = [(1 + cos) / 2, -1 - cos, (1 + cos) / 2], plain
    elif kind == "BandPass":
        b, a = [alpha, 0, -alpha], plain
    elif kind == "AllPass":
        b, a = plain[::-1], plain
    elif kind == "Notch":
        b, a = [1, -2 * cos, 1], plain
    elif kind == "Peaking":
        b, a = [1 + alpha * amp, -2 * cos, 1 - alpha * amp], [1 + alpha / amp, -2 * cos, 1 - alpha / amp]
    elif kind in ("LowShelf", "HighShelf"):
        s = 1 if kind == "LowShelf" else -1  # the high shelf mirrors the low one in frequency
        up, down, root = amp + 1, (amp - 1) * s, 2 * np.sqrt(amp) * alpha
        b = [amp * (up - down * cos + root), 2 * amp * s * ((amp - 1) - up * s * cos), amp * (up - down * cos - root)]
        a = [up + down * cos + root, -2 * s * ((amp - 1) + up * s * cos), up + down * cos - root]
    else:
        raise ValueError(f"invalid kind of filter: {kind}")
    return np.array(b) / a[0], np.array(a) / a[0]


def equalizer_stages(gains, rate: float) -> list:
    kinds = ["LowShelf", *["Peaking"] * (len(BANDS) - 2), "HighShelf"]
    return [biquad(k, fc, bw, float(g), rate) for k, (fc, bw), g in zip(kinds, BANDS, gains)]


@register_attack("EqualizerAttack", "kernel", gains=[10, 10, 10, 10, 0, 0, -5, -10, -10, -10])
def equalizer(c: Clip, gains) -> Column:
    """Eight stages, each adding its filter's output to its input; then the peak becomes 1."""

    def run(x: np.ndarray, r: int) -> np.ndarray:
        for b, a in equalizer_stages(gains, r):
            x = x + dsp.iir(b, a, x)
        return x

    return kernel(c, run, causal=True, finish=lambda y: y / (np.abs(y).max() or 1.0))


@register_attack("ResamplingPolyAttack", "kernel", down_factor=2)
def resampling_poly(c: Clip, down_factor) -> Column:
    if not isinstance(down_factor, int):
        raise TypeError("down_factor must be a whole number")
    q = down_factor
    return each(c, lambda x, r: dsp.poly_resample(dsp.poly_resample(x, 1, q, dsp.decimation_taps(q)), q, 1))


@register_attack("STFTQuantizationAttack", "kernel", n_fft=1024, hop_length=512, quantization_levels=256)
def stft_quantization(c: Clip, n_fft, hop_length, quantization_levels) -> Column:
    return each(c, lambda x, r: dsp.quantize_spectrum(x, min(n_fft, len(x) - len(x) % 2 or 2), min(hop_length, max(1, min(n_fft, len(x)) // 2)), quantization_levels))


@register_attack("WaveletAttack", "kernel", wavelet="db1", wt_mode="soft", threshold_factor=0.5)
def wavelet(c: Clip, wavelet, wt_mode, threshold_factor) -> Column:
    check(wavelet in dsp.SCALING, f"unknown wavelet: {wavelet}")
    return each(c, lambda x, r: dsp.wavelet_denoise(x, wavelet, wt_mode, threshold_factor))


def _frame(n: int) -> int:
    """A spectrum size for stretching that fits short clips too."""
    size = 2048
    while size > 16 and size > n:
        size //= 2
    return size


@register_attack("TimeStretchAttack", "kernel", stretch_rate=1.4)
def time_stretch(c: Clip, stretch_rate) -> Column:
    """A rate over 1 slows down, as documented."""
    check(stretch_rate > 0, "stretch_rate must be positive")
    return together(c, lambda x: dsp.stretch(x, float(stretch_rate), _frame(x.shape[1])))


@register_attack("InvertedTimeStretch", "kernel", inverted_stretch_rate=2.0)
def inverted_time_stretch(c: Clip, inverted_stretch_rate) -> Column:
    check(inverted_stretch_rate > 0, "inverted_stretch_rate must be positive")
    k = float(inverted_stretch_rate)
    return together(c, lambda x: dsp.stretch(dsp.stretch(x, k, _frame(x.shape[1])), 1 / k, _frame(x.shape[1])))


@register_attack("PitchShiftAttack", "kernel", cents=5.0)
def pitch_shift(c: Clip, cents) -> Column:
    return together(c, lambda x: dsp.shift_pitch(x, float(cents) / 100, _frame(x.shape[1])))


#: Third-order approximation of a slope of -3 dB an octave.
PINK = [0.049922035, -0.095993537, 0.050612699, -0.004408786], [1.0, -2.494956002, 2.017265875, -0.522189400]


@register_attack("PinkNoiseAttack", "kernel", amplitude=0.03)
def pink_noise(c: Clip, amplitude) -> Column:
    seed = f"{c.seed}:pink"

    @F.pandas_udf("array<double>")
    def go(key: pd.Series, audio: pd.Series) -> pd.Series:
        white = pd.Series([None if a is None else normals_of(seed, k, len(a)) for k, a in zip(key, audio)])
        pink = stacked(white, pd.Series([0] * len(white)), lambda x, r: dsp.iir(*PINK, x), causal=True)
        return pd.Series([a if a is None or not len(a) else np.asarray(a) + p / (np.abs(p).max() or 1.0) * float(amplitude) for a, p in zip(audio, pink)])

    return go(c.id.cast("string"), c.audio)


@register_attack("ReplacementAttack", "kernel", replacement_block_size=1024, replacement_overlap_factor=0.75, replacement_lower_bound=0.0, replacement_upper_bound=10.0, replacement_use_masking=False, k=100)
def replacement(c: Clip, replacement_block_size, replacement_overlap_factor, replacement_lower_bound, replacement_upper_bound, replacement_use_masking, k) -> Column:
    """Blocks replaced by fits from similar blocks of the same clip; the lower bound has no effect."""
    size = int(replacement_block_size)
    hop = size - int(replacement_overlap_factor * size)

    def run(x: np.ndarray, r: int) -> np.ndarray:
        from tremolo.functions.psychoacoustics import MaskingModel

        return dsp.replace_blocks(x, size, hop, float(replacement_upper_bound), k, MaskingModel(size, r) if replacement_use_masking else None)

    return each(c, run)


@register_attack("Mp3CompressionAttack", "kernel", quality=3)
def mp3(c: Clip, quality) -> Column:
    """Through an encoder and back where ffmpeg is installed on the executors; else it raises."""

    def run(x: np.ndarray, r: int) -> np.ndarray:
        from tremolo.sources.files import mp3_round_trip

        return mp3_round_trip(x, r, quality)

    return each(c, run)
