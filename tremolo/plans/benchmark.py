"""The benchmark as one plan: embed, attack, detect, score, average.

Every clip is read and marked once. Attacks that are expressions and attacks that are
kernels become columns of the same row and one explode makes a row for each attack, so
there is no product join, no union of scans and no shuffle before the final average.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions import dsp, metrics
from tremolo.functions.bits import message
from tremolo.operators import attacks as _expressions
from tremolo.operators import kernels as _kernels
from tremolo.operators.catalog import Clip, attack, attacked, bind, choose, model


def run(clips: DataFrame, model_name: str = "SpreadA", attack_types: list[str] | None = None, seed: str = "7", per_clip: bool = False, quality: bool = False, params: dict[str, dict] | None = None, bits: Column | None = None, sampling_rate: int | None = None) -> DataFrame:
    """clip_id, attack, accuracy, accuracy_cross_model, snr, psnr, si_sdr[, stoi, pesq] for clips(clip_id, sampling_rate, audio).

    attack_types: None for all that need no service and no ffmpeg; unknown names are left out
    with a warning. per_clip:
    a message for each clip instead of one for the run. quality: STOI of the attack on the
    unmarked clip, with draws of its own; PESQ stays null, there is no public reference of it.
    sampling_rate: clips of another rate are resampled to it first; None for the model's rate.
    Attacks and models that are services can be named after sources.remote.register_services;
    the accuracy of a model that detects one score is that score.
    """
    m = model(model_name)
    names, unknown = choose(attack_types)
    if unknown:
        warnings.warn(f"unknown attacks are left out: {', '.join(sorted(unknown))}", stacklevel=2)
    if not attack_types:
        names = [n for n in names if n != "Mp3CompressionAttack"]
    to = sampling_rate or m.rate
    m = m.at(to)
    sent = bits if bits is not None else message(f"{seed}:message", m.bits, *([F.col("clip_id")] if per_clip else []))
    here = Clip(F.col("clip_id"), F.col("audio"), F.col("sampling_rate"))
    # a clip column of one literal rate folds this away where there is nothing to do
    audio = F.when(F.col("sampling_rate") == to, F.col("audio")).otherwise(_kernels.each(here, lambda x, r: dsp.resample(x, r, to)))
    clips = clips.withColumn("audio", audio).withColumn("sampling_rate", F.lit(to))
    marked = clips.withColumn("bits", sent).withColumn("original", F.col("audio"))
    marked = bind(marked, "audio", m.embed(F.col("original"), F.col("bits")))
    params = params or {}
    clip = Clip(F.col("clip_id"), F.col("audio"), F.col("sampling_rate"), F.col("original"), seed, m)
    return _scored(marked, clip, names, params, m, quality)


def _scored(marked: DataFrame, clip: Clip, names: list[str], params: dict, m, quality: bool) -> DataFrame:
    kernel = [n for n in names if attack(n).kind != "expression"]
    wide = marked
    for k, n in enumerate(kernel):
        wide = wide.withColumn(f"k{k}", attacked(n, clip, **params.get(n, {})))
    plain = Clip(clip.id, clip.original, clip.rate, clip.original, f"{clip.seed}:quality", m)
    if quality:
        for k, n in enumerate(kernel):
            wide = wide.withColumn(f"q{k}", attacked(n, plain, **params.get(n, {})))

    def rows(audio: Column) -> Column:
        here = Clip(clip.id, audio, clip.rate, clip.original, clip.seed, m)
        out = []
        for n in names:
            got = F.col(f"k{kernel.index(n)}") if n in kernel else attacked(n, here, **params.get(n, {}))
            fields = [F.lit(n).alias("attack"), got.alias("attacked")]
            if n == "CrossModelAttack":
                from tremolo.operators.catalog import model as find

                other = find(attack(n).params(params.get(n))["different_model_name"])
                fields += [_expressions.cross_message(clip, other).alias("cross_bits")]
            else:
                fields += [F.lit(None).cast("array<int>").alias("cross_bits")]
            if quality:
                fields += [(F.col(f"q{kernel.index(n)}") if n in kernel else attacked(n, plain, **params.get(n, {}))).alias("degraded")]
            out.append(F.struct(*fields))
        return F.array(*out) if out else F.array().cast("array<struct<attack:string,attacked:array<double>,cross_bits:array<int>>>")

    each = wide.select("clip_id", "sampling_rate", "bits", "audio", "original", F.explode(rows(F.col("audio"))).alias("a")).select("clip_id", "sampling_rate", "bits", "audio", "original", "a.*")
    cross = F.lit(None).cast("double")
    if "CrossModelAttack" in names:
        other = model(attack("CrossModelAttack").params(params.get("CrossModelAttack"))["different_model_name"])
        cross = F.when(F.col("cross_bits").isNotNull(), _agreement(F.col("cross_bits"), other, F.col("attacked")))
    a, b = F.col("audio"), F.col("attacked")
    out = [
        "clip_id", "attack", _agreement(F.col("bits"), m, b).alias("accuracy"), cross.alias("accuracy_cross_model"),
        metrics.snr(a, b).alias("snr"), metrics.psnr(a, b).alias("psnr"), metrics.si_sdr(a, b).alias("si_sdr"),
    ]
    if quality:
        out += [stoi(F.col("original"), F.col("degraded"), F.col("sampling_rate")).alias("stoi"), F.lit(None).cast("double").alias("pesq")]
    return each.select(*out)


def _agreement(sent: Column, m, audio: Column) -> Column:
    found = m.detect(audio)
    return F.get(found, F.lit(0)) if m.scores else metrics.accuracy(sent.cast("array<double>"), found)


def stoi(clean: Column, degraded: Column, rate: Column) -> Column:
    """Short-time objective intelligibility; null for clips of under about 0.4 s of loud frames.

    Scores are of clips at 8 or 16 kHz: those of other rates are resampled to 16 kHz first.
    """

    def score(a, b, r: int) -> float | None:
        if r in (8000, 16000):
            return dsp.stoi(a, b, r)
        return dsp.stoi(dsp.resample(np.asarray(a, float), r, 16000), dsp.resample(np.asarray(b, float), r, 16000), 16000)

    @F.pandas_udf("double")
    def go(x: pd.Series, y: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or not len(a) or not len(b) else score(a, b, int(q)) for a, b, q in zip(x, y, r)], dtype="float64")

    return go(clean, degraded, rate)


def nmr(clean: Column, degraded: Column, rate: Column, size: int = 1024, hop: int = 256) -> Column:
    """Noise-to-mask ratio (dB) over the 109 fractional bands; below about -9 the difference can't be heard. Null clips give null."""
    @F.pandas_udf("double")
    def go(x: pd.Series, y: pd.Series, r: pd.Series) -> pd.Series:
        from tremolo.functions.psychoacoustics import noise_to_mask

        return pd.Series([None if a is None or b is None else noise_to_mask(a, b, int(q), size, hop) for a, b, q in zip(x, y, r)], dtype="float64")

    return go(clean, degraded, rate)


def mean_accuracy(results: DataFrame) -> DataFrame:
    """attack, n, accuracy_mean, accuracy_cross_model_mean; nulls don't count."""
    return results.groupBy("attack").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy_mean"), F.avg("accuracy_cross_model").alias("accuracy_cross_model_mean"))
