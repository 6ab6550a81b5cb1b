"""Audio files, configurations and results: readers and writers that Spark distributes."""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import subprocess
import tempfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.functions import dsp


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where Spark is all in it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tremolo-")


def has_audio_suffix(path):
    return F.lower(path).rlike(r"\.(wav|mp3)$")


def stem(path):
    """File name without folders and without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"^(.+)\.[^.]*$", "$1")


def pcm_samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1), the channels' mean, of PCM of 8 to 32 bits; KeyError for other widths."""
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1)


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a wav file."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    return pcm_samples(raw, width, channels), rate


def encode_wav(x, rate: int) -> bytes:
    """16-bit PCM; rows of a 2-D array are channels."""
    codes = np.clip(np.atleast_2d(np.asarray(x, float)).T * 32767, -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(codes.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(codes.tobytes())
    return out.getvalue()


def read_clips(spark: SparkSession, folder: str, rate: int | None = None) -> DataFrame:
    """clip_id (file name), sampling_rate, audio, error of the wav and mp3 files in a folder, not below it.

    Files that can't be decoded have a null clip and say why in error: mp3 files, which nothing
    here decodes, and broken ones. Other files are not opened; Spark doesn't list files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.{[wW][aA][vV],[mM][pP]3}").load(folder).where(has_audio_suffix(F.col("path")))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                x, r, error = None, None, "not a wav file"
                if path.lower().endswith(".wav"):
                    try:
                        (x, r), error = decode_wav(content), None
                    except (wave.Error, EOFError, KeyError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                if x is not None and rate and rate != r:
                    x, r = dsp.resample(x, r, rate), rate
                rows.append((os.path.basename(path), r, x, error))
            yield pd.DataFrame(rows, columns=["clip_id", "sampling_rate", "audio", "error"]).astype({"sampling_rate": "Int32"})

    return files.select("path", "content").mapInPandas(decode, "clip_id string, sampling_rate int, audio array<double>, error string")


def write_clips(clips: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes <stem>_<suffix>.wav for each clip to a folder all executors share; returns name and size.

    A file is written under another name first and then moved, so a task that runs again is safe.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for name, what, r, x in zip(batch["clip_id"], batch["what"], batch["sampling_rate"], batch["audio"]):
                data = encode_wav(x, int(r))
                base = os.path.splitext(str(name))[0]
                target = os.path.join(folder, f"{base}_{what}.wav")
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
                    f.write(data)
                os.replace(f.name, target)
                rows.append((os.path.basename(target), len(data)))
            yield pd.DataFrame(rows, columns=["name", "bytes"])

    what = F.col(suffix) if suffix in clips.columns else F.lit(suffix)
    return clips.select(F.col("clip_id").cast("string"), what.alias("what"), "sampling_rate", "audio").mapInPandas(write, "name string, bytes long")


def read_config(path: str) -> dict:
    """A JSON object; FileNotFoundError if there is none, ValueError if it can't be read."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    try:
        with open(path) as f:
            return json.load(f)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} isn't JSON: {e}") from e


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def mp3_round_trip(x: np.ndarray, rate: int, quality: int) -> np.ndarray:
    """16-bit PCM through ffmpeg's mp3 encoder and back."""
    if not shutil.which("ffmpeg"):
        raise RuntimeError("ffmpeg isn't installed")
    with tempfile.TemporaryDirectory() as d:
        with open(f"{d}/a.wav", "wb") as f:
            f.write(encode_wav(x, rate))
        for a, b, more in (("a.wav", "b.mp3", ["-codec:a", "libmp3lame", "-q:a", str(quality)]), ("b.mp3", "c.wav", ["-ar", str(rate)])):
            subprocess.run(["ffmpeg", "-y", "-loglevel", "error", "-i", f"{d}/{a}", *more, f"{d}/{b}"], check=True, timeout=300)
        with open(f"{d}/c.wav", "rb") as f:
            return decode_wav(f.read())[0]
