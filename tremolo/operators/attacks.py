"""Attacks as column expressions over the array of a clip's samples: no shuffle, no Python.

Each takes a Clip and its parameters and returns the attacked audio. Draws depend on seed,
clip and position only. Silent clips are returned unscaled where others are divided by
their peak.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.functions.arrays import at, let, lets, peak, positions, total
from tremolo.functions.bits import message
from tremolo.functions.rng import normal, uniform
from tremolo.operators.catalog import Clip, model, register_attack


def check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@register_attack("SignInversionAttack")
def sign_inversion(c: Clip) -> Column:
    return F.transform(c.audio, lambda x: -x)


@register_attack("PCMQuantizationAttack", pcm=16)
def pcm(c: Clip, pcm: int) -> Column:
    """Whole codes, cut toward zero."""
    check(pcm in (8, 16, 24), f"unsupported depth: {pcm}")
    scale = float(2 ** (pcm - 1) - 1)
    code = lambda x: F.least(F.greatest(x * scale, F.lit(-scale - 1)), F.lit(scale)).cast("int")
    return F.transform(c.audio, lambda x: code(x) / F.lit(scale))


@register_attack("QuantizationAttack", quantization_bit=256)
def quantization(c: Clip, quantization_bit: int) -> Column:
    """Nearest of so many levels between the clip's extremes; the parameter counts levels."""
    steps = float(quantization_bit - 1)
    return lets([F.array_min(c.audio), F.array_max(c.audio)], lambda a, b: F.transform(c.audio, lambda x: F.rint((x - a) / (b - a + 1e-8) * steps) / steps * (b - a) + a))


@register_attack("SmoothingAttack", window_size=10)
def smoothing(c: Clip, window_size: int) -> Column:
    """Moving mean, always over window_size samples, zeros outside; at least that many come out."""
    w, n = window_size, F.size(c.audio)
    short = n < w
    ahead = F.when(short, F.floor((n - 1) / 2)).otherwise(F.lit((w - 1) // 2)).cast("int")

    def mean(i: Column) -> Column:
        last = F.least(i + ahead, n - 1)
        first = F.greatest(i + ahead - (w - 1), F.lit(0))
        return total(F.slice(c.audio, first + 1, F.greatest(last - first + 1, F.lit(0)))) / w

    return F.when(n == 0, c.audio).otherwise(F.transform(positions(F.greatest(n, F.lit(w))), mean))


def _delayed(a: Column, i: Column, tau: Column) -> Column:
    """The signal tau samples before i, between two samples in proportion."""
    d = F.floor(tau).cast("int")
    return at(a, i - d - 1) * (tau - d) + at(a, i - d) * (1 - (tau - d))


def _lfo(c: Clip, i: Column, start: float, width: float, rate: float) -> Column:
    return F.floor(c.rate * start) + F.floor(c.rate * width) * F.sin(F.lit(2 * math.pi * rate) * i / c.rate)


def _unit_peak(a: Column) -> Column:
    return let(a, lambda y: let(peak(y), lambda p: F.when(p == 0, y).otherwise(F.transform(y, lambda v: v / p))))


@register_attack("ChorusAttack", start_delays=[0.02, 0.06, 0.14], w_delays=[0.03, 0.03, 0.03], delay_rates=[2.0, 1.2, 1.2], dry_gain=1.0, chorus_gains=[0.05, 0.05, 0.05])
def chorus(c: Clip, start_delays, w_delays, delay_rates, dry_gain, chorus_gains) -> Column:
    def step(x: Column, i: Column) -> Column:
        y = x * float(dry_gain)
        for s, w, r, g in zip(start_delays, w_delays, delay_rates, chorus_gains, strict=True):
            y = y + _delayed(c.audio, i, _lfo(c, i, s, w, r)) * float(g)
        return y

    return _unit_peak(F.transform(c.audio, step))


@register_attack("FlangerAttack", start_delay=0.01, w_delay=0.003, delay_rate=1.0, gain=1.0)
def flanger(c: Clip, start_delay, w_delay, delay_rate, gain) -> Column:
    return F.transform(c.audio, lambda x, i: x + _delayed(c.audio, i, _lfo(c, i, start_delay, w_delay, delay_rate)) * float(gain))


@register_attack("EchoAttack", volume_range=[0.1, 0.5], duration_range=[0.1, 0.5])
def echo(c: Clip, volume_range, duration_range) -> Column:
    """One delayed copy; the peak over the whole tail becomes the clip's peak."""
    (v0, v1), (d0, d1) = volume_range, duration_range

    def mixed(delay: Column, volume: Column) -> Column:
        n = F.size(c.audio)
        whole = F.transform(positions(n + delay), lambda i: at(c.audio, i) + volume * at(c.audio, i - delay))
        return let(whole, lambda y: lets([peak(y), peak(c.audio)], lambda p, q: F.transform(F.slice(y, F.lit(1), n), lambda x: F.when(p == 0, x).otherwise(x / p * q))))

    delay = F.floor(c.rate * (F.lit(float(d0)) + F.lit(float(d1 - d0)) * uniform(f"{c.seed}:echo-delay", c.id))).cast("int")
    return lets([delay, F.lit(float(v0)) + F.lit(float(v1 - v0)) * uniform(f"{c.seed}:echo-volume", c.id)], mixed)


@register_attack("AdditiveNoiseAttack", noise_level=0.003)
def additive_noise(c: Clip, noise_level) -> Column:
    return F.transform(c.audio, lambda x, i: x + F.lit(float(noise_level)) * normal(f"{c.seed}:noise", c.id, i))


@register_attack("GaussianNoiseAttack", snr_db=20.0)
def gaussian_noise(c: Clip, snr_db) -> Column:
    """Noise whose expected power is the signal's, snr_db lower."""
    power = F.when(F.size(c.audio) > 0, total(c.audio, lambda x: x * x) / F.size(c.audio) / F.lit(10 ** (float(snr_db) / 10)))
    return let(F.sqrt(power), lambda s: F.transform(c.audio, lambda x, i: x + s * normal(f"{c.seed}:gauss", c.id, i)))


def _segment(c: Clip, seconds: float, what: str) -> tuple[Column, Column]:
    """Start and length of a segment drawn for the clip; the whole clip if that is shorter."""
    n = F.size(c.audio)
    size = F.least(F.floor(c.rate * float(seconds)).cast("int"), n)
    return F.floor(uniform(f"{c.seed}:{what}-start", c.id) * (n - size)).cast("int"), size


def _ranked(c: Clip, what: str, n: Column) -> Column:
    """0 to n - 1 in drawn order."""
    drawn = F.transform(positions(n), lambda i: F.struct(uniform(f"{c.seed}:{what}", c.id, i).alias("u"), i.alias("i")))
    return F.transform(F.sort_array(drawn), lambda s: s["i"])


@register_attack("CutSamplesAttack", cut_max_sequence_length=20, cut_num_sequences=20, cut_duration=0.5, cut_max_value_difference=0.1)
def cut_samples(c: Clip, cut_max_sequence_length, cut_num_sequences, cut_duration, cut_max_value_difference) -> Column:
    """Short cuts at distinct places of a segment, where the joint's step is small.

    Cuts go in order of place; one that would reach the segment's end stops them, and one
    that begins inside an earlier, longer cut sets the next kept sample back to its own end.
    """

    def cut(start: Column, size: Column) -> Column:
        places = F.sort_array(F.slice(_ranked(c, "cut-place", size - cut_max_sequence_length), 1, cut_num_sequences))
        empty = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0).alias("since"), F.lit(False).alias("over"))
        sample = lambda i: F.get(c.audio, start + i)

        def step(s: Column, i: Column) -> Column:
            end = i + F.floor(uniform(f"{c.seed}:cut-length", c.id, i) * cut_max_sequence_length).cast("int") + 1
            over = s["over"] | (end >= size)
            skip = over | (F.abs(sample(i) - sample(F.least(end, size - 1))) > float(cut_max_value_difference))
            out = F.concat(s["out"], F.slice(c.audio, start + s["since"] + 1, F.greatest(i - s["since"], F.lit(0))))
            return F.when(skip, F.struct(s["out"].alias("out"), s["since"].alias("since"), over.alias("over"))).otherwise(F.struct(out.alias("out"), end.alias("since"), F.lit(False).alias("over")))

        done = F.aggregate(places, empty, step)
        return let(done, lambda s: F.concat(F.slice(c.audio, F.lit(1), start), s["out"], F.slice(c.audio, start + s["since"] + 1, F.size(c.audio))))

    return lets(list(_segment(c, cut_duration, "cut")), cut)


@register_attack("FlipSamplesAttack", num_flips=50, flip_duration=0.5)
def flip_samples(c: Clip, num_flips, flip_duration) -> Column:
    """Pairs of distinct samples of a segment change places; an odd one out stays."""

    def flip(start: Column, size: Column) -> Column:
        count = F.floor(F.least(F.lit(2 * num_flips), size) / 2).cast("int") * 2
        drawn = let(F.slice(_ranked(c, "flip-place", size), F.lit(1), count), lambda r: F.transform(r, lambda i, k: F.struct((start + i).alias("to"), (start + F.get(r, k.bitwiseXOR(F.lit(1)))).alias("from"))))
        return let(F.map_from_entries(drawn), lambda m: F.transform(c.audio, lambda x, i: F.coalesce(F.get(c.audio, F.element_at(m, i)), x)))

    return lets(list(_segment(c, flip_duration, "flip")), flip)


def crossings(a: Column) -> Column:
    """Positions whose sign differs from the next one's; zero is a sign of its own."""
    return F.filter(positions(F.size(a) - 1), lambda i: F.signum(F.get(a, i)) != F.signum(F.get(a, i + 1)))


@register_attack("ZeroCrossInsertsAttack", zero_cross_pause_length=20, zero_cross_min_distance=1.0)
def zero_cross_inserts(c: Clip, zero_cross_pause_length, zero_cross_min_distance) -> Column:
    """Zeros before sign changes that are far enough from the last insertion."""
    least = F.floor(c.rate * float(zero_cross_min_distance)).cast("int")
    pause = F.array_repeat(F.lit(0.0), zero_cross_pause_length)
    empty = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0).alias("since"), (-least).alias("last"))

    def step(s: Column, i: Column) -> Column:
        out = F.concat(s["out"], F.slice(c.audio, s["since"] + 1, i - s["since"]), pause)
        return F.when(i - s["last"] >= least, F.struct(out.alias("out"), i.alias("since"), i.alias("last"))).otherwise(s)

    return let(F.aggregate(crossings(c.audio), empty, step), lambda s: F.concat(s["out"], F.slice(c.audio, s["since"] + 1, F.size(c.audio))))


@register_attack("ZeroBitCollusionAttack", needs=("original",), x=20.0, position="random")
def zero_bit_collusion(c: Clip, x, position) -> Column:
    """So many percent of the samples become the original's again."""
    check(position in ("random", "front", "end"), f"invalid position: {position}")
    if x <= 0:
        return c.audio
    n = F.size(c.audio)
    count = F.floor(F.least(n, F.size(c.original)) * F.lit(float(x)) / 100).cast("int")
    own, other = c.audio, c.original
    if position == "front":
        return F.concat(F.slice(other, F.lit(1), count), F.slice(own, count + 1, n))
    if position == "end":
        return F.concat(F.slice(own, F.lit(1), n - count), F.slice(other, F.size(other) - count + 1, count))
    chosen = F.slice(_ranked(c, "collude", F.least(n, F.size(other))), F.lit(1), count)
    flags = lambda m: F.transform(own, lambda v, i: F.when(F.map_contains_key(m, i), F.get(other, i)).otherwise(v))
    return let(F.map_from_entries(F.transform(chosen, lambda i: F.struct(i, F.lit(True)))), flags)


@register_attack("CollusionAttack", needs=("original", "model"), collusion_size=25)
def collusion(c: Clip, collusion_size) -> Column:
    """Segments from either of two differently marked versions, by a coin for each segment."""
    second = c.model.embed(c.original, message(f"{c.seed}:collusion", c.model.bits, c.id))
    return let(second, lambda b: F.transform(c.audio, lambda x, i: F.when(uniform(f"{c.seed}:coin", c.id, F.floor(i / collusion_size)) > 0.5, x).otherwise(F.get(b, i))))


@register_attack("SameModelAttack", needs=("model",))
def same_model(c: Clip) -> Column:
    return c.model.embed(c.audio, message(f"{c.seed}:same-model", c.model.bits, c.id))


@register_attack("CrossModelAttack", different_model_name="SpreadB")
def cross_model(c: Clip, different_model_name) -> Column:
    other = model(different_model_name)
    return other.embed(c.audio, cross_message(c, other))


def cross_message(c: Clip, other) -> Column:
    return message(f"{c.seed}:cross-model", other.bits, c.id)


def haar_threshold(details: Column, n: Column, factor: float) -> Column:
    """sigma sqrt(2 ln n) factor; sigma is the median magnitude of details over 0.6745."""
    a = F.sort_array(F.transform(details, F.abs))
    m = F.size(details)
    middle = (F.get(a, F.floor((m - 1) / 2).cast("int")) + F.get(a, F.floor(m / 2).cast("int"))) / 2
    return F.when(m > 0, middle / 0.6745 * F.sqrt(F.lit(2.0) * F.ln(n.cast("double"))) * float(factor)).otherwise(F.lit(0.0))
