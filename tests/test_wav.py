"""Wav files as a data source, framing as a table function."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import by_sample
from tremolo.functions import dsp, tables
from tremolo.operators.scan import filter_blocks
from tremolo.sources import clips as C
from tremolo.sources import files, wav


@pytest.fixture
def folder(spark, tmp_path):
    wav.register(spark)
    return str(tmp_path)


def put(folder, name, x, rate=16000):
    with open(f"{folder}/{name}", "wb") as f:
        f.write(files.encode_wav(x, rate))


def codes(x):
    return np.trunc(np.clip(np.asarray(x) * 32767, -32768, 32767)) / 32768


@pytest.mark.parametrize("size", [1000, 1 << 21, 64 << 20])
def test_read(spark, folder, size):
    rng = np.random.default_rng(3)
    want = {"a.wav": rng.uniform(-1, 1, 5000), "b.WAV": rng.uniform(-1, 1, 7), "none.wav": np.zeros(0)}
    for name, x in want.items():
        put(folder, name, x)
    put(folder, "two.wav", np.array([[0.5, 0.5, 0.0], [0.5, -0.5, 1.0]]), 8000)
    for name, content in (("bad.wav", b"no wav"), ("empty.wav", b""), ("song.mp3", b"ID3"), ("note.txt", b"x")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    with open(f"{folder}/a.wav", "rb") as f, open(f"{folder}/short.wav", "wb") as g:
        g.write(f.read()[: 44 + 2 * 1234 + 1])  # cut within a sample
    os.makedirs(f"{folder}/below")
    put(f"{folder}/below", "deep.wav", [0.1])
    for segment in (0, 1, 300):
        rows = spark.read.format("wav").option("segment", segment).option("partitionBytes", size).load(folder).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.block):
            got.setdefault(r.clip_id, []).append(r)
        assert set(got) == {*want, "two.wav", "bad.wav", "empty.wav", "song.mp3", "short.wav"}
        for name, x in want.items():
            parts = got[name]
            assert [r.block for r in parts] == list(range(max(1, -(-len(x) // segment)) if segment else 1)) and all(r.error is None for r in parts)
            assert np.allclose(np.concatenate([r.audio for r in parts]), codes(x))
        assert np.allclose(np.concatenate([r.audio for r in got["two.wav"]]), [0.5, 0, 0.5], atol=1e-4) and got["two.wav"][0].sampling_rate == 8000
        for name in ("bad.wav", "empty.wav", "song.mp3"):
            assert len(got[name]) == 1 and got[name][0].audio is None and got[name][0].error
        if segment:
            assert sum(len(r.audio or []) for r in got["short.wav"]) >= 1234 // segment * segment
    assert spark.read.format("wav").load(f"{folder}/below").count() == 1


def test_long_file_in_parts(spark, folder):
    x = np.random.default_rng(5).uniform(-1, 1, 20000)
    put(folder, "long.wav", x)
    rows = spark.read.format("wav").option("segment", 512).option("partitionBytes", 5000).load(folder)
    assert rows.rdd.getNumPartitions() == 9
    b, a = dsp.polynomials(dsp.butter(5, 5000 / 8000, "lowpass"))
    got = sorted(filter_blocks(rows.select("clip_id", "block", "audio"), b, a, 512).collect(), key=lambda r: r.block)
    assert np.allclose(np.concatenate([r.audio for r in got]), by_sample(b, a, codes(x), np.zeros(len(a) - 1))[0], atol=1e-9)


def test_write(spark, folder):
    rows = spark.createDataFrame([(f"{k}.x.wav", 8000, [k / 10, -2.0, 2.0], "more") for k in range(7)] + [("empty", 8000, [], "")], "clip_id string, sampling_rate int, audio array<double>, block string")
    at = f"{folder}/out"
    rows.repartition(3).write.format("wav").option("suffix", "marked").mode("append").save(at)
    assert sorted(os.listdir(at)) == [*(f"{k}.x_marked.wav" for k in range(7)), "empty_marked.wav"]
    got = {r.clip_id: r for r in spark.read.format("wav").load(at).collect()}
    assert got["3.x_marked.wav"].sampling_rate == 8000 and np.allclose(got["3.x_marked.wav"].audio, codes([0.3, -2, 2])) and got["empty_marked.wav"].audio == []
    with pytest.raises(Exception, match="same name"):
        rows.write.format("wav").option("suffix", "marked").mode("append").save(at)
    rows.limit(1).write.format("wav").option("suffix", "marked").mode("overwrite").save(at)
    assert len(os.listdir(at)) == 8
    rows.where("false").write.format("wav").mode("append").save(at)
    with pytest.raises(Exception, match="same name"):
        rows.unionAll(rows).write.format("wav").mode("append").save(at)
    assert len(os.listdir(at)) == 8


def test_failed_task_leaves_no_file(spark, folder):
    at = f"{folder}/out"
    rows = spark.range(40).repartition(4).select(F.col("id").alias("clip_id"), F.lit(8000).alias("sampling_rate"), F.when(F.col("id") != 33, F.array(F.lit(0.5))).alias("audio"))
    with pytest.raises(Exception, match="no name, rate or audio"):
        rows.write.format("wav").mode("append").save(at)
    assert not os.path.exists(at) or os.listdir(at) == []
    with pytest.raises(Exception, match="no column audio"):
        rows.drop("audio").write.format("wav").mode("append").save(at)


@pytest.mark.parametrize("size,hop", [(16, 4), (5, 5), (3, 7), (1, 1), (64, 48)])
def test_framing_by_table_function(spark, size, hop):
    rng = np.random.default_rng(size)
    clips = {1: 333, 2: 16, 3: 1, 4: 5000, None: 9}
    data = {c: rng.normal(size=n) for c, n in clips.items()}
    rows = spark.createDataFrame([(c, i, float(v)) for c, x in data.items() for i, v in enumerate(x)], "clip_id long, i int, x double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {(r.clip_id, r.m): r.block for r in tables.frames_of(rows, size, hop).collect()}
        tables.register(spark, "framed", size, hop)
        rows.createOrReplaceTempView("samples_to_frame")
        assert spark.sql("SELECT * FROM framed(TABLE(samples_to_frame) PARTITION BY clip_id ORDER BY i)").count() == len(got)
        assert tables.frames_of(rows.where("false"), size, hop).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    arrays = spark.createDataFrame([(c, 1, x.tolist()) for c, x in data.items()], "clip_id long, sampling_rate int, audio array<double>")
    want = {(r.clip_id, r.m): r.block for r in C.frames(arrays, size, hop).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_null_samples_count_as_zero(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0)], "clip_id string, i int, x double")
    assert [(r.clip_id, r.m, r.block) for r in tables.frames_of(rows, 2, 1, windowed=False).orderBy("m").collect()] == [("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 3.0])]
    with pytest.raises(ValueError):
        tables.frame_table(0, 1)
