"""Attacks with their usual parameters, and the quality scores, against plain loops over samples."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.functions import dsp
from tremolo.operators import catalog
from tremolo.plans import benchmark, queries
from tremolo.sources import clips as C

SF = "/root/testdata/sf0.001"
RATE = 16000


def one(spark, x, rate=RATE):
    return spark.createDataFrame([(1, rate, [float(v) for v in x])], "clip_id long, sampling_rate int, audio array<double>")


def attacked(spark, x, name, rate=RATE, **params):
    return np.array(catalog.apply(one(spark, x, rate), name, **params).first().audio)


def tone(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.sin(np.arange(n) * 0.11) * 0.5 + rng.normal(size=n) * 0.1


def plain_stretch(x, factor, size):
    """The phase vocoder bin by bin, with sums for transforms."""
    hop, half = size // 4, size // 2
    w = [0.5 - 0.5 * math.cos(2 * math.pi * j / size) for j in range(size)]
    turns = [cmath.exp(-2j * math.pi * p / size) for p in range(size)]
    padded = [0.0] * half + list(x) + [0.0] * half
    padded += [0.0] * (-(len(padded) - size) % hop)
    frames = [[sum(padded[at + j] * w[j] * turns[j * k % size] for j in range(size)) for k in range(half + 1)] for at in range(0, len(padded) - size + 1, hop)]
    count = len(frames)
    frames += [[0j] * (half + 1)] * 2
    phase = [cmath.phase(v) for v in frames[0]]
    out, n = [], 0
    while n / factor < count - 1e-9:
        i, part = int(n / factor), n / factor - int(n / factor)
        out.append([((1 - part) * abs(p) + part * abs(q)) * cmath.exp(1j * f) for p, q, f in zip(frames[i], frames[i + 1], phase)])
        for k in range(half + 1):
            usual = 2 * math.pi * hop * k / size
            turn = cmath.phase(frames[i + 1][k]) - cmath.phase(frames[i][k]) - usual
            phase[k] += usual + turn - 2 * math.pi * round(turn / (2 * math.pi))
        n += 1
    total, norm = np.zeros((len(out) - 1) * hop + size), np.zeros((len(out) - 1) * hop + size)
    for m, s in enumerate(out):
        whole = s[: half + 1] + [v.conjugate() for v in s[half - 1 : 0 : -1]]
        whole[0], whole[half] = complex(whole[0].real), complex(whole[half].real)
        for j in range(size):
            total[m * hop + j] += sum(v * turns[-j * k % size] for k, v in enumerate(whole)).real / size * w[j]
            norm[m * hop + j] += w[j] ** 2
    y = (total / np.where(norm > 1e-10, norm, 1.0))[half : len(total) - half]
    length = round(len(x) * factor)
    return np.pad(y, (0, max(0, length - len(y))))[:length]


def test_vocoder_against_sums(spark):
    x = tone(45)  # spectra of 32 points
    want = plain_stretch(x, 1.4, 32)
    assert np.allclose(attacked(spark, x, "TimeStretchAttack"), want, atol=1e-8)
    there = plain_stretch(x, 2.0, 32)
    assert np.allclose(dsp.stretch(there, 0.5, 32), plain_stretch(there, 0.5, 32), atol=1e-8)
    assert np.allclose(attacked(spark, x, "InvertedTimeStretch"), plain_stretch(there, 0.5, 32), atol=1e-8)
    ratio = 2 ** (5 / 1200)
    y = plain_stretch(x, ratio, 32)
    want = [y[int(t)] * (1 - t + int(t)) + (y[int(t) + 1] * (t - int(t)) if int(t) + 1 < len(y) else 0) if t <= len(y) - 1 else y[-1] for t in (i * ratio for i in range(len(x)))]
    assert np.allclose(attacked(spark, x, "PitchShiftAttack"), want, atol=1e-8)


def plain_burg(x, order):
    """Reflections one by one, each sum taken anew."""
    f, b, a = list(x), list(x), [1.0]
    for _ in range(order):
        f, b = f[1:], b[:-1]
        k = -2 * sum(p * q for p, q in zip(f, b)) / sum(p * p + q * q for p, q in zip(f, b))
        a = [p + k * q for p, q in zip([*a, 0.0], [0.0, *a[::-1]])]
        f, b = [p + k * q for p, q in zip(f, b)], [q + k * p for p, q in zip(f, b)]
    return a


def test_prediction_of_order_12(spark):
    x = tone(700)
    a = plain_burg(x, 12)
    want = [-sum(a[j] * x[i - j] for j in range(1, 13) if i >= j) for i in range(len(x))]
    assert np.allclose(attacked(spark, x, "LPCAttack"), want, atol=1e-8)


def delayed(x, i, tau):
    d = math.floor(tau)
    get = lambda j: x[j] if 0 <= j < len(x) else 0.0
    return get(i - d - 1) * (tau - d) + get(i - d) * (1 - (tau - d))


def test_chorus_and_flanger_with_usual_delays(spark):
    x = tone(6000)
    wave = lambda i, s, w, r: math.floor(RATE * s) + math.floor(RATE * w) * math.sin(2 * math.pi * r * i / RATE)
    voices = [(0.02, 0.03, 2.0), (0.06, 0.03, 1.2), (0.14, 0.03, 1.2)]
    y = np.array([x[i] + 0.05 * sum(delayed(x, i, wave(i, *v)) for v in voices) for i in range(len(x))])
    assert np.allclose(attacked(spark, x, "ChorusAttack"), y / np.abs(y).max(), atol=1e-8)
    assert np.allclose(attacked(spark, x, "FlangerAttack"), [x[i] + delayed(x, i, wave(i, 0.01, 0.003, 1.0)) for i in range(len(x))], atol=1e-8)


@pytest.mark.parametrize("rate", [8000, 16000, 22050])
def test_scores_at_8_or_16_khz(spark, rate):
    x = tone(rate)
    y = x + np.random.default_rng(1).normal(size=rate) * 0.2
    rows = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    got = rows.select(benchmark.stoi(F.col("x"), F.col("y"), F.lit(rate))).first()[0]
    p, q, r = (dsp.resample(x, rate, 16000), dsp.resample(y, rate, 16000), 16000) if rate == 22050 else (x, y, rate)
    assert got == pytest.approx(dsp.stoi(p, q, r)) and 0 < got < 0.99


def test_quality_of_the_attack_on_the_unmarked_clip(spark):
    clips = C.lineitem_clips(C.table(spark, SF, "lineitem"), 500)
    got = {(r.clip_id, r.attack): r for r in queries.bench_quality(spark, SF).collect()}
    noisy = catalog.apply(clips.withColumn("plain", F.col("audio")), "GaussianNoiseAttack", seed="7:quality").collect()
    assert len(got) == 2 * len(noisy) and any(r.stoi is not None for r in got.values())
    for r in noisy:
        x, y = (dsp.resample(np.array(v), 500, 16000) for v in (r.plain, r.audio))
        want, turned = dsp.stoi(x, y, 16000), dsp.stoi(x, -x, 16000)
        for name, score in (("GaussianNoiseAttack", want), ("SignInversionAttack", turned)):
            row = got[r.clip_id, name]
            assert row.pesq is None and (row.stoi is None if score is None else row.stoi == pytest.approx(score, abs=1e-9))
