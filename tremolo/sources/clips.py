"""Clips (clip_id, sampling_rate, audio) from tables, and layouts of their samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATE = 16000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(clips: DataFrame) -> DataFrame:
    """Dealt over all cores if they are in fewer files than that; larger inputs stay as they are.

    Attacks cost far more than moving a clip, and a file of one row group is one task.
    """
    cores = clips.sparkSession.sparkContext.defaultParallelism
    return clips.repartition(cores) if len(clips.inputFiles()) < cores else clips


def embedding_clips(embeddings: DataFrame, rate: int = RATE) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("clip_id"), F.lit(rate).alias("sampling_rate"), F.col("embedding").cast("array<double>").alias("audio"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(clip_id, audio) of rows (clip_id, x) that come clip by clip; one clip is held beside a batch."""
    made = lambda ids, ends, x: pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), x)], ["clip_id", "audio"])
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, x = pc.run_end_encode(batch.column(0)), batch.column(1)
        ids, ends = runs.values, runs.run_ends.to_numpy()
        begins = np.append(0, ends[:-1])
        if held and ids[0].as_py() != last[0].as_py():
            whole = pa.concat_arrays(held)
            yield made(last, [len(whole)], whole)
            held = []
        if held and len(ids) > 1:
            whole = pa.concat_arrays([*held, x.slice(0, ends[0])])
            yield made(last, [len(whole)], whole)
            held, ids, begins, ends = [], ids[1:], begins[1:], ends[1:]
        if len(ids) > 1:
            yield made(ids[:-1], ends[:-1] - begins[0], x.slice(begins[0], ends[-2] - begins[0]))
        last = ids[-1:]
        held.append(x.slice(begins[-1]))
    if held:
        whole = pa.concat_arrays(held)
        yield made(last, [len(whole)], whole)


def gathered(rows: DataFrame, rate: int, *order: str) -> DataFrame:
    """Clips of rows(clip_id, x, ...), the samples of each in the order given, nulls first.

    Rows are sorted as they are and cut into lists in batches; lists of structs that are sorted as arrays cost several times as much.
    """
    kind = rows.schema["clip_id"].dataType.simpleString()
    ordered = rows.repartition("clip_id").sortWithinPartitions("clip_id", *order).select("clip_id", F.col("x").cast("double"))
    return ordered.mapInArrow(_lists, f"clip_id {kind}, audio array<double>").select("clip_id", F.lit(rate).alias("sampling_rate"), "audio")


def from_samples(samples: DataFrame, rate: int = RATE) -> DataFrame:
    """samples(clip_id, i, x), a row for each sample, gathered in order of i."""
    return gathered(samples, rate, "i", "x")


def to_samples(clips: DataFrame) -> DataFrame:
    return clips.select("clip_id", F.posexplode("audio").alias("i", "x"))


def event_samples(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).alias("i"), F.col("value").alias("x"))


def lineitem_clips(lineitem: DataFrame, rate: int = RATE) -> DataFrame:
    """A clip for each supplier, in order of order, line, part and price."""
    x = (F.col("l_extendedprice") / F.lit(1e5) - F.lit(0.5)).alias("x")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return gathered(lineitem.select(F.col("l_suppkey").alias("clip_id"), x, *order), rate, *order)


def frames(clips: DataFrame, size: int, hop: int, windowed: bool = True) -> DataFrame:
    """(clip_id, m, block): overlapping blocks, zero-padded at the end, windowed."""
    import math

    from tremolo.functions.arrays import at

    n = F.size("audio")
    count = F.greatest(F.ceil((n - F.lit(size)) / F.lit(hop)).cast("int") + 1, F.lit(1))
    rows = clips.where(n > 0).select("clip_id", "audio", F.explode(F.sequence(F.lit(0), count - 1)).alias("m"))
    shape = lambda j: F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * (j + 1) / F.lit(size + 1))
    block = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: at(F.col("audio"), F.col("m") * hop + j) * (shape(j) if windowed else F.lit(1.0)))
    return rows.select("clip_id", "m", block.alias("block"))
