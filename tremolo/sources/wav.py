"""Wav files as a data source of Spark: spark.read.format("wav") and df.write.format("wav"), after register(spark).

Paths are those that pyarrow's file systems open (mounted folders, s3, gs, hdfs); files.read_clips takes
any path that Spark reads, but a whole file at a time. Here small files share a partition and, with the option
segment, long ones are split over several, so that a recording of any length is never in one task whole.
"""

from __future__ import annotations

import os
import re
import uuid
import wave
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tremolo.sources.files import encode_wav, pcm_samples

SCHEMA = "clip_id string, block long, sampling_rate int, audio array<double>, error string"
_ARROW = pa.schema([("clip_id", pa.string()), ("block", pa.int64()), ("sampling_rate", pa.int32()), ("audio", pa.list_(pa.float64())), ("error", pa.string())])
#: What opening a file counts, in bytes, when files are dealt to partitions.
OPENING = 1 << 20


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:(?=/[^/])", "", path).rstrip("/"))


class WavSource(DataSource):
    """Rows (clip_id: the file's name, block, sampling_rate, audio: the channels' mean in [-1, 1), error).

    Reading takes the wav and mp3 files in a folder, not below it. Options: segment, samples a row (0, the
    usual: a row holds its whole file and block is 0); partitionBytes (64 MB). A file that can't be decoded is
    one row with null audio and the reason in error, a file without samples one row with empty audio; a
    file cut short gives what is there.

    Writing takes clip_id, sampling_rate and audio (other columns are ignored) and makes <name without suffix>[_<suffix>].wav,
    16 bits, suffix being an option. Files are written under a folder of the job's own and moved when all tasks
    are done, so a failed job leaves none. Two rows of one name, null values, and in mode append names
    that are there already are errors; overwrite replaces files of the same names and leaves the others.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        if [f.name for f in schema.fields] != _ARROW.names:
            raise ValueError(f"the columns of wav files are {SCHEMA}")
        return _Reader(self.options["path"], int(self.options.get("segment", 0)), int(self.options.get("partitionBytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"clip_id", "sampling_rate", "audio"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return _Writer(self.options["path"], self.options.get("suffix", ""), overwrite)


@dataclass
class _Pieces(InputPartition):
    """Files, each with the byte its part begins at and the byte before which it ends (None: wherever the file does)."""

    parts: list[tuple[str, int, int | None]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, segment: int, size: int):
        if segment < 0 or size < 1:
            raise ValueError("segment and partitionBytes must be positive")
        self.path, self.segment, self.size = path, segment, size

    def partitions(self) -> list[_Pieces]:
        store, folder = _store(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and re.search(r"\.(wav|mp3)$", f.path.lower()))
        out: list[_Pieces] = []
        load = 0
        for path, n in found:
            starts = range(0, max(n, 1), self.size) if self.segment else [0]
            for lo in starts:
                end = None if lo == starts[-1] else lo + self.size
                weight = OPENING + (n if not self.segment else min(self.size, n - lo))
                if not out or load + weight > self.size:
                    out.append(_Pieces([]))
                    load = 0
                out[-1].parts.append((path, lo, end))
                load += weight
        return out

    def read(self, partition: _Pieces | None) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)[0]
        for path, lo, hi in partition.parts if partition else []:
            for row in self._rows(store, path, lo, hi):
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    def _rows(self, store: fs.FileSystem, path: str, lo: int, hi: int | None) -> Iterator[dict]:
        row = {"clip_id": os.path.basename(path), "block": 0}
        try:
            if not path.lower().endswith(".wav"):
                raise wave.Error("not a wav file")
            with store.open_input_file(path) as raw, wave.open(raw) as f:
                width, channels, rate, n = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.getnframes()
                each = self.segment or max(n, 1)
                # a segment belongs to the part where it begins, counted from the first sample
                first, stop = (-(-at // (each * width * channels)) if at is not None else -(-n // each) for at in (lo, hi))
                if lo == 0:
                    stop = max(stop, 1)
                for k in range(first, min(stop, max(-(-n // each), 1))):
                    f.setpos(min(k * each, n))
                    x = pcm_samples(f.readframes(each), width, channels)
                    if k and not len(x):
                        break
                    yield row | {"block": k, "sampling_rate": rate, "audio": x}
        except (wave.Error, EOFError, KeyError, ValueError) as e:
            if lo == 0:
                yield row | {"error": f"{type(e).__name__}: {e}"}


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        store, folder = _store(self.path)
        moves: list[tuple[str, str]] = []
        store.create_dir(f"{folder}/{self.job}", recursive=True)
        for row in iterator:
            if row["clip_id"] is None or row["sampling_rate"] is None or row["audio"] is None:
                raise ValueError(f"clip {row['clip_id']} has no name, rate or audio")
            name = os.path.splitext(os.path.basename(str(row["clip_id"])))[0] + (f"_{self.suffix}" if self.suffix else "") + ".wav"
            aside = f"{folder}/{self.job}/{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as f:
                f.write(encode_wav(np.array(row["audio"], float), int(row["sampling_rate"])))
            moves.append((aside, f"{folder}/{name}"))
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        moves = [m for w in messages if w for m in w.moves]
        names = [to for _, to in moves]
        twice = sorted(n for n, times in Counter(names).items() if times > 1)
        there = [] if self.overwrite else [i.path for i in store.get_file_info(names) if i.type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files of the same name: {', '.join([*twice, *there][:5])}")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        """Deletes what the job has written and not moved."""
        store, folder = _store(self.path)
        if store.get_file_info(f"{folder}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.job}")
