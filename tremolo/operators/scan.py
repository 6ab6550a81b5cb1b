"""Recursive filters over clips too long for one task: blocks as affine maps of the state, composed by prefix.

A block of samples acts on a filter's state as s -> P s + u, with P fixed by the filter and the
block's length. Blocks are filtered from a state of zeros wherever they are; their u, as many numbers
as the filter's order, are composed along the clip; and each block adds what its first state
gives. Samples move once, to form blocks; only the u are gathered by clip, a row for each block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions import dsp


def sample_blocks(samples: DataFrame, size: int) -> DataFrame:
    """(clip_id, block, audio) of samples(clip_id, i, x), i from 0 without gaps; the last block of a clip can be shorter."""
    rows = samples.groupBy("clip_id", F.floor(F.col("i") / size).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return rows.select("clip_id", "block", F.transform("s", lambda s: s["x"].cast("double")).alias("audio"))


def filter_blocks(blocks: DataFrame, b, a, size: int) -> DataFrame:
    """The filtered blocks; all but a clip's last have size samples. Null and empty audio stays as it is."""
    m = dsp.blocked(b, a, size)
    if not m.calm:
        raise ValueError("the states of this filter can't be composed without loss: filter by its second-order sections, one after the other")
    kind = blocks.schema["clip_id"].dataType.simpleString()

    @F.pandas_udf("audio array<double>, fed array<double>")
    def alone(audio: pd.Series) -> pd.DataFrame:
        got = [(x, None) if x is None or not len(x) else tuple(v[0] for v in dsp.iir_with_state(b, a, x)) for x in audio]
        return pd.DataFrame(got, columns=["audio", "fed"])

    def along(_, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        zero = np.zeros(len(m.power))
        fed = np.stack([zero if f is None else np.asarray(f) for f in rows["fed"]])
        states = dsp.carried(fed[None], m.power, zero[None])[0, :-1]
        return pd.DataFrame({"clip_id": rows["clip_id"], "block": rows["block"], "state": list(states)})

    @F.pandas_udf("array<double>")
    def with_state(audio: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or not len(x) else np.asarray(x) + m.seen[: len(x)] @ np.asarray(s) for x, s in zip(audio, state)])

    first = blocks.select("clip_id", "block", alone("audio").alias("y")).select("clip_id", "block", "y.audio", "y.fed")
    states = first.select("clip_id", "block", "fed").groupBy("clip_id").applyInPandas(along, f"clip_id {kind}, block long, state array<double>")
    return first.join(states, ["clip_id", "block"]).select("clip_id", "block", with_state("audio", "state").alias("audio"))
