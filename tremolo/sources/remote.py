"""Models and attacks that run as HTTP services, batch by batch from the executors.

Transports are those of `sources.transport`; the default keeps connections, tries again and has a deadline.
Requests are idempotent, so a task that runs again may repeat them. A batch's requests go out
several at a time (`flight`), and its rows keep their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions import dsp
from tremolo.operators import catalog
from tremolo.operators.models import SERVICES
from tremolo.sources.transport import Patient, Transport, in_flight

PATIENT = Patient()


def answered(answer: dict, key: str):
    if key not in answer:
        raise KeyError(f"the service's answer has no {key}")
    return answer[key]


@dataclass(frozen=True)
class RemoteModel:
    name: str
    url: str
    rate: int
    bits: int
    timeout: float = 300.0
    transport: Transport = PATIENT
    flight: int = 4

    def mark(self, a, w, r) -> list:
        return answered(self.transport(f"{self.url}/embed", {"audio": list(map(float, a)), "watermark_data": list(map(int, w)), "sampling_rate": int(r)}, self.timeout), "watermarked_audio")

    def find(self, a, r) -> tuple[list | None, float | None]:
        """Detected message (or null) and score (or null)."""
        got = self.transport(f"{self.url}/detect", {"audio": list(map(float, a)), "sampling_rate": int(r)}, self.timeout).get("watermark")
        return (None, float(got)) if isinstance(got, (int, float)) else (got, None)

    def embed(self, clips: DataFrame) -> DataFrame:
        """clips(clip_id, sampling_rate, audio, bits) with marked audio."""

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["audio"] = list(in_flight(self.flight, self.mark, zip(b["audio"], b["bits"], b["sampling_rate"])))
                yield b

        return clips.select("clip_id", "sampling_rate", "audio", "bits").mapInPandas(go, f"clip_id {clips.schema['clip_id'].dataType.simpleString()}, sampling_rate int, audio array<double>, bits array<int>")

    def detect(self, clips: DataFrame) -> DataFrame:
        """clips(clip_id, sampling_rate, audio) with detected (null, bits or nulls) and score.

        A single number as answer is a confidence: it goes to score and detected is null.
        """

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = list(in_flight(self.flight, self.find, zip(b["audio"], b["sampling_rate"])))
                yield pd.DataFrame({"clip_id": b["clip_id"], "detected": [g[0] for g in got], "score": [g[1] for g in got]})

        return clips.select("clip_id", "sampling_rate", "audio").mapInPandas(go, f"clip_id {clips.schema['clip_id'].dataType.simpleString()}, detected array<double>, score double")


@dataclass(frozen=True)
class ServiceModel:
    """A remote model by columns, for benchmark runs; clips are at rate. scores: it detects one number, not a message."""

    remote: RemoteModel
    scores: bool = False
    rate: int = 0

    @property
    def name(self) -> str:
        return self.remote.name

    @property
    def bits(self) -> int:
        return self.remote.bits

    def at(self, rate: int) -> ServiceModel:
        return replace(self, rate=rate)

    def embed(self, audio: Column, bits: Column) -> Column:
        @F.pandas_udf("array<double>")
        def mark(audio: pd.Series, bits: pd.Series) -> pd.Series:
            ask = lambda a, w: None if a is None else self.remote.mark(a, w, self.rate)
            return pd.Series(list(in_flight(self.remote.flight, ask, zip(audio, bits))), dtype=object)

        return mark(audio, bits)

    def detect(self, audio: Column) -> Column:
        """The message, or the score alone; null if the service found nothing."""

        @F.pandas_udf("array<double>")
        def find(audio: pd.Series) -> pd.Series:
            ask = lambda a: (None, None) if a is None else self.remote.find(a, self.rate)
            found = in_flight(self.remote.flight, ask, zip(audio))
            return pd.Series([bits if score is None else [score] for bits, score in found], dtype=object)

        return find(audio)


@dataclass(frozen=True)
class RemoteAttack:
    """rate: what the service works at (null: the clip's); multiple: lengths are cut to a multiple of it, before resampling."""

    name: str
    url: str
    rate: int | None = None
    multiple: int = 1
    timeout: float = 300.0
    params: dict = field(default_factory=dict)
    limits: dict = field(default_factory=dict)
    transport: Transport = PATIENT
    flight: int = 4

    def settled(self, given: dict) -> dict:
        params = self.params | {k: v for k, v in given.items() if v is not None}
        for k, most in self.limits.items():
            if abs(params[k]) > most:
                raise ValueError(f"{self.name}: {k} must be at most {most}")
        return params

    def one(self, a: np.ndarray, r: int, params: dict) -> np.ndarray:
        x = np.asarray(a, float)
        to = self.rate or r
        x = dsp.resample(x[: len(x) // self.multiple * self.multiple], r, to)
        y = answered(self.transport(f"{self.url}/attack", {"audio": x.tolist(), "sampling_rate": int(to)} | params, self.timeout), "audio")
        return dsp.resample(np.asarray(y, float), to, r)

    def __call__(self, clips: DataFrame, **given) -> DataFrame:
        params = self.settled(given)

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["audio"] = list(in_flight(self.flight, lambda a, r: self.one(a, int(r), params), zip(b["audio"], b["sampling_rate"])))
                yield b

        return clips.select("clip_id", "sampling_rate", "audio").mapInPandas(go, f"clip_id {clips.schema['clip_id'].dataType.simpleString()}, sampling_rate int, audio array<double>")

    def column(self, c: catalog.Clip, **given) -> Column:
        """The attacked audio as a column, for the registry of attacks."""
        params = self.settled(given)

        @F.pandas_udf("array<double>")
        def ask(audio: pd.Series, rate: pd.Series) -> pd.Series:
            one = lambda a, r: None if a is None else self.one(a, int(r), params)
            return pd.Series(list(in_flight(self.flight, one, zip(audio, rate))), dtype=object)

        return ask(c.audio, c.rate)


@dataclass(frozen=True)
class SlicedAttack(RemoteAttack):
    """An attack whose service takes one slice at a time: slices overlap, and each begins with the end of the one before.

    size and overlap count samples at `rate`. Slices of a clip go out in order, clips side by side. The answer has the
    clip's range (a flat answer stays flat). The end of a clip that no whole stride begins is lost beyond the last slice.
    """

    size: int = 1 << 17
    overlap: int = 44100
    seed: int = 0

    def one(self, a: np.ndarray, r: int, params: dict) -> np.ndarray:
        to = self.rate or r
        x = dsp.resample(np.asarray(a, float), r, to)

        def ask(part: np.ndarray, kept: int) -> np.ndarray:
            sent = {"audio": part.tolist(), "sampling_rate": int(to), "mask_start_secs": kept / to, "seed": self.seed} | params
            return np.asarray(answered(self.transport(f"{self.url}/slice", sent, self.timeout), "audio"), float)

        return dsp.in_range_of(x, dsp.resample(dsp.in_slices(x, self.size, self.overlap, ask), to, r))


def neural_attacks(base: str = "http://localhost", transport: Transport = PATIENT) -> dict[str, RemoteAttack]:
    """The attacks that are services, with the rates and limits of their contracts."""
    return {
        a.name: a
        for a in (
            RemoteAttack("VAEAttack", f"{base}/vae", 48000, 2048, transport=transport),
            RemoteAttack("DiffusionAttack", f"{base}/diffusion", None, params={"diffusion_steps": 20}, limits={"diffusion_steps": 150}, transport=transport),
            RemoteAttack("NeuralVocoderAttack", f"{base}/vocoder", 44100, transport=transport),
            RemoteAttack("SpeechEnhancementAttack", f"{base}/enhancement", 16000, params={"noise_strength": 0.001}, limits={"noise_strength": 0.01}, transport=transport),
            RemoteAttack("SpeechTokenizationAttack", f"{base}/tokenization", 16000, timeout=180.0, transport=transport),
        )
    }


def register_services(base: str, transport: Transport = PATIENT, urls: dict[str, str] | None = None) -> None:
    """Makes the models and attacks that are services known to benchmark runs; urls: where one isn't at base/name.

    Attacks so registered run when they are named, never as part of all.
    """
    urls = urls or {}
    for name, (rate, bits) in SERVICES.items():
        remote = RemoteModel(name, urls.get(name, f"{base}/{name.removesuffix('Model').lower()}"), rate, bits, transport=transport)
        catalog.register_model(ServiceModel(remote, name == "PerthModel", rate))
    for name, a in neural_attacks(base, transport).items():
        a = replace(a, url=urls.get(name, a.url))
        catalog.register_attack(name, "remote", **a.params)(a.column)
