"""Table functions over samples in the long layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.functions.dsp import hann_open


def frame_table(size: int, hop: int, windowed: bool = True, key: str = "bigint"):
    """A table function of TABLE(samples(clip_id, i, x)) PARTITION BY clip_id ORDER BY i, with rows (clip_id, m, block).

    The blocks are those of sources.clips.frames, but a clip is never gathered: a task holds a batch of it and fewer
    samples than a block and a hop. i only orders. Null samples count as 0, a null clip_id is a clip; of equal
    i any comes first. key: the type of clip_id.
    """
    if size < 1 or hop < 1:
        raise ValueError("size and hop must be positive")
    w = hann_open(size) if windowed else np.ones(size)

    class Frames:
        def __init__(self):
            self.clip, self.rest, self.skip, self.seen, self.m = None, np.zeros(0), 0, 0, 0

        def _table(self, blocks: np.ndarray) -> pa.Table:
            first, self.m = self.m, self.m + len(blocks)
            values = pa.array((blocks * w).ravel())
            block = pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1, dtype=np.int32) * size), values)
            return pa.table({"clip_id": pa.array([self.clip] * len(blocks), self.type), "m": pa.array(np.arange(first, self.m, dtype=np.int32)), "block": block})

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            if not batch.num_rows:
                return
            ids = batch.column(batch.schema.get_field_index("clip_id"))
            self.clip, self.type = ids[0].as_py(), ids.type
            x = batch.column(batch.schema.get_field_index("x")).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            self.seen += len(x)
            at = min(self.skip, len(x))
            self.skip -= at
            x = np.concatenate([self.rest, x[at:]])
            if len(x) >= size:
                blocks = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
                gone = len(blocks) * hop
                self.skip = max(0, gone - len(x))
                self.rest = x[gone:].copy()
                for k in range(0, len(blocks), 1024):
                    yield self._table(blocks[k : k + 1024])
            else:
                self.rest = x

        def terminate(self) -> Iterator[pa.Table]:
            left = (max(0, -(-(self.seen - size) // hop)) + 1 if self.seen else 0) - self.m
            if left > 0:
                x = np.pad(self.rest, (0, max(0, (left - 1) * hop + size - len(self.rest))))
                yield self._table(np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:left])

    return F.arrow_udtf(Frames, returnType=f"clip_id {key}, m int, block array<double>")


def frames_of(samples: DataFrame, size: int, hop: int, windowed: bool = True) -> DataFrame:
    """(clip_id, m, block) of samples(clip_id, i, x) by the table function."""
    rows = samples.select("clip_id", "i", F.col("x").cast("double").alias("x"))
    go = frame_table(size, hop, windowed, samples.schema["clip_id"].dataType.simpleString())
    return go(rows.asTable().partitionBy("clip_id").orderBy("i"))


def register(spark: SparkSession, name: str, size: int, hop: int, windowed: bool = True) -> None:
    """For SQL: SELECT * FROM name(TABLE(samples) PARTITION BY clip_id ORDER BY i)."""
    spark.udtf.register(name, frame_table(size, hop, windowed))
