"""A recursive filter over clips whose chunks arrive in any order, with what came early held in state.

Needs the RocksDB state store (`on_rocksdb` sets it while streams start). One clip's chunks are
one key, as a filter's memory goes from one to the next; many clips spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tremolo.functions import dsp

OUT = "clip_id long, seq long, audio array<double>, skipped long, late boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class ChunkFilter(StatefulProcessor):
    """State of a clip: the number that is due and the filter's memory, chunks that came early, and a deadline."""

    def __init__(self, b, a, patience_ms: int):
        self.b, self.a, self.patience = np.asarray(b, float), np.asarray(a, float), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "due long, memory array<double>, deadline long")
        self.early = handle.getMapState("early", "seq long", "audio array<double>")

    def _rest(self):
        return np.zeros(max(len(self.a), len(self.b)) - 1)

    def _run(self, due: int, memory: np.ndarray, chunks: dict, held: set, out: list, skipped: int = 0) -> tuple[int, np.ndarray]:
        """Filters the chunks that are due one after the other; chunks holds the new ones, state those of before, held their numbers."""
        while True:
            if due in chunks:
                x = chunks.pop(due)
            elif due in held:
                x = self.early.getValue((due,))[0]
                self.early.removeKey((due,))
                held.discard(due)
            else:
                return due, memory
            x = np.asarray(x, float)
            y = x
            if len(x):
                y, memory = (v[0] for v in dsp.iir_with_state(self.b, self.a, x, memory[None]))
            out.append((due, y, skipped, False))
            due, skipped = due + 1, 0

    @staticmethod
    def _frame(key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["clip_id", "seq", "audio", "skipped", "late"])

    def _put(self, due: int, memory: np.ndarray, old: int | None, deadline: int) -> None:
        if old is not None and old != deadline:
            self.handle.deleteTimer(old)
        if old != deadline:
            self.handle.registerTimer(deadline)
        self.place.update((due, memory.tolist(), deadline))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        known = self.place.exists()
        due, memory, old = self.place.get() if known else (0, self._rest(), None)
        held = {k[0] for k in self.early.keys()} if known else set()
        chunks, out = {}, []
        for seq, x in zip(rows["seq"], rows["audio"]):
            if seq < due or seq in chunks or seq in held:
                out.append((int(seq), None, 0, True))
            else:
                chunks[int(seq)] = x
        due, memory = self._run(due, np.asarray(memory, float), chunks, held, out)
        for seq, x in chunks.items():
            self.early.updateValue((seq,), ([float(v) for v in x],))
        last = int(rows["ts"].max().value // 1_000_000)
        self._put(due, memory, old, max(old or 0, last + self.patience))
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        due, _, deadline = self.place.get()
        if expiredTimerInfo.getExpiryTimeInMs() != deadline:
            return
        held, out = {k[0] for k in self.early.keys()}, []
        while held:
            first = min(held)
            due, _ = self._run(first, self._rest(), {}, held, out, skipped=first - due)
        self.early.clear()
        self.place.clear()
        yield from self._frame(key, out)


def filtered_in_any_order(chunks: DataFrame, b, a, patience: str = "1 hour") -> DataFrame:
    """chunks(clip_id long, seq long from 0, audio array<double>, ts timestamp with a watermark), each filtered once.

    Returns clip_id, seq, audio, skipped, late. A chunk goes out when all before it have; until then it is held.
    When the watermark passes a clip's last ts by `patience`, held chunks go out after the gap (skipped: how many
    numbers are missing just before it) from a filter at rest, and the clip is forgotten; what comes later is taken
    as a new clip's. Chunks that repeat a number or come after the gap was passed have late set and no audio.
    Rows at or behind the watermark are dropped by Spark, which counts them (numRowsDroppedByWatermark). Empty chunks
    pass through; null clip_id is a clip of its own; rows with a null seq, audio or ts are left out.
    """
    rows = chunks.select("clip_id", "seq", "audio", "ts").where("seq >= 0 and audio is not null and ts is not null")
    ms = int(pd.Timedelta(patience) / pd.Timedelta("1ms"))
    return rows.groupBy("clip_id").transformWithStateInPandas(ChunkFilter(b, a, ms), OUT, "append", "eventTime")


@contextmanager
def on_rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the setting is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
