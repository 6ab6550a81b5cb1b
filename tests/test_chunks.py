"""Chunks in any order over several triggers against the filter over whole clips."""

import datetime as dt

import numpy as np

from tremolo.functions import dsp
from tremolo.streaming.chunks import filtered_in_any_order, on_rocksdb

B, A = dsp.polynomials(dsp.butter(2, 0.3, "lowpass"))
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "clip_id long, seq long, audio array<double>, ts timestamp"


def run(spark, path, triggers, patience="1 hour"):
    """triggers: lists of (clip, seq, samples, minute); each becomes a file and a trigger of its own."""
    for k, rows in enumerate(triggers):
        rows = [(c, s, None if x is None else [float(v) for v in x], T0 + dt.timedelta(minutes=m)) for c, s, x, m in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withWatermark("ts", "1 minute")
    with on_rocksdb(spark):
        q = filtered_in_any_order(stream, B, A, patience).writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        q.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


def test_any_order_equals_the_whole_clip(spark, tmp_path):
    rng = np.random.default_rng(0)
    clips = {c: rng.normal(size=40) for c in range(3)}
    chunks = [(c, k, x[10 * k : 10 * k + 10], 0) for c, x in clips.items() for k in range(4)] + [(0, 4, [], 0), (None, 1, [2.0], 0), (None, 0, [1.0], 0)]
    order = rng.permutation(len(chunks))
    triggers = [[chunks[i] for i in order[at : at + 5]] for at in range(0, len(order), 5)]
    triggers[-1] += [chunks[order[0]], (0, 9, None, 0), (0, None, [1.0], 0)]  # a repeat, no audio, no number
    got = run(spark, tmp_path, triggers)
    assert [(r.clip_id, r.seq) for r in got if r.late] == [(chunks[order[0]][0], chunks[order[0]][1])]
    got = sorted((-1 if r.clip_id is None else r.clip_id, r.seq, r.audio, r.skipped) for r in got if not r.late)
    assert len(got) == len(chunks) and all(g[3] == 0 for g in got)
    for c, x in clips.items():
        assert np.allclose(np.concatenate([g[2] for g in got if g[0] == c]), dsp.iir(B, A, x)[0])


def test_a_gap_is_passed_when_the_watermark_is(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=10)
    triggers = [[(1, 0, x, 0), (1, 3, x, 0), (1, 2, x, 0), (1, 6, x, 0)], [(2, 0, x, 200)], [(2, 1, x, 201)], [(2, 2, x, 202)], [(1, 1, x, 0)]]
    got = {(r.clip_id, r.seq): r for r in run(spark, tmp_path, triggers)}
    assert {k: r.skipped for k, r in got.items()} == {(1, 0): 0, (1, 2): 1, (1, 3): 0, (1, 6): 2, (2, 0): 0, (2, 1): 0, (2, 2): 0}
    two = dsp.iir(B, A, np.concatenate([x, x]))[0]
    assert np.allclose(got[1, 2].audio + got[1, 3].audio, two) and np.allclose(got[1, 6].audio, two[:10]) and np.allclose(got[1, 0].audio, two[:10])
