"""Structured Streaming over the same columns: running means, windowed sums, filters with state.

An extension: each stream's final state equals the batch result over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tremolo.functions import dsp


def running_accuracy(results: DataFrame) -> DataFrame:
    """attack, n, accuracy_mean so far (update mode)."""
    return results.groupBy("attack").agg(F.count("accuracy").alias("n"), F.avg("accuracy").alias("accuracy_mean"))


def windowed_values(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by event time and type; rows later than `late` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_values(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), "user_id", "n", "total")


def filtered(chunks: DataFrame, b, a) -> DataFrame:
    """Recursive filter over clips that arrive in chunks (clip_id long, seq long, audio array<double>).

    A clip's filter memory is the state. Chunks of a trigger are taken in order of seq; a
    chunk must not arrive after a later one of an earlier trigger.
    """
    import numpy as np

    b, a = np.asarray(b, float), np.asarray(a, float)
    order = max(len(a), len(b)) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = np.array(state.get[0]) if state.exists else np.zeros(order)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, x in zip(rows["seq"], rows["audio"]):
            y, memory = (v[0] for v in dsp.iir_with_state(b, a, np.asarray(x, float), memory[None]))
            out.append((key[0], seq, y))
        state.update((memory.tolist(),))
        yield pd.DataFrame(out, columns=["clip_id", "seq", "audio"])

    return chunks.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, seq long, audio array<double>", "memory array<double>", "append", GroupStateTimeout.NoTimeout)

