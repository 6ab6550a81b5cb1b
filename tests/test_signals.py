import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.functions import bits, metrics
from tremolo.operators import attacks, catalog, kernels  # noqa: F401
from tremolo.operators.models import SPREAD_A
from tremolo.plans import benchmark, report
from tremolo.sources import clips as C


def clip(spark, *arrays, rate=16000):
    return spark.createDataFrame([(i, rate, list(map(float, a))) for i, a in enumerate(arrays)], "clip_id long, sampling_rate int, audio array<double>")


def out(df):
    return [r.audio for r in df.orderBy("clip_id").collect()]


def test_small_attacks(spark):
    c = clip(spark, [0.5, -0.25, 0.0])
    assert out(catalog.apply(catalog.apply(c, "SignInversionAttack"), "SignInversionAttack"))[0] == [0.5, -0.25, 0.0]
    assert out(catalog.apply(clip(spark, [1.7 / 127, -1.7 / 127]), "PCMQuantizationAttack", pcm=8))[0] == [1 / 127, -1 / 127]
    got = out(catalog.apply(clip(spark, [0, 0.5, 1.5, 2.5, 4]), "QuantizationAttack", quantization_bit=5))[0]
    assert [round(v) for v in got] == [0, 0, 1, 2, 4]  # the epsilon below pulls ties down
    squares = [float(i * i) for i in range(20)]
    got = out(catalog.apply(clip(spark, squares), "SmoothingAttack"))[0]
    assert abs(got[10] - sum(squares[5:15]) / 10) < 1e-9
    assert len(out(catalog.apply(clip(spark, [1.0, 2.0]), "SmoothingAttack"))[0]) == 10


def test_zero_crossings_and_inserts(spark):
    c = clip(spark, [1, 0, -1, -2, 3])
    assert c.select(attacks.crossings(F.col("audio")).alias("z")).first().z == [0, 1, 3]
    got = out(catalog.apply(c, "ZeroCrossInsertsAttack", zero_cross_pause_length=2, zero_cross_min_distance=2 / 16000))[0]
    assert got == [0, 0, 1, 0, -1, 0, 0, -2, 3]


def test_silent_clips(spark):
    c = clip(spark, [0.0] * 40).withColumn("original", F.col("audio"))
    for name in ("ChorusAttack", "EchoAttack", "EqualizerAttack", "QuantizationAttack", "FlangerAttack", "WaveletAttack"):
        assert out(catalog.apply(c, name))[0] is not None


def test_errors(spark):
    c = clip(spark, [0.0] * 8)
    for name, params in (("PCMQuantizationAttack", {"pcm": 12}), ("ZeroBitCollusionAttack", {"position": "middle"}), ("NoSuchAttack", {}), ("SmoothingAttack", {"other": 1})):
        with pytest.raises(ValueError):
            catalog.apply(c, name, original="audio", **params)
    with pytest.raises(TypeError):
        catalog.apply(c, "ResamplingPolyAttack", down_factor=2.0)
    with pytest.raises(ValueError):
        catalog.apply(c, "CollusionAttack")
    with pytest.raises(ValueError):
        catalog.model("NoSuchModel")


def test_collusion_parts_complement(spark):
    c = clip(spark, range(10)).withColumn("original", F.transform("audio", lambda x: -x))
    front = out(catalog.apply(c, "ZeroBitCollusionAttack", original="original", position="front", x=50.0))[0]
    end = out(catalog.apply(c, "ZeroBitCollusionAttack", original="original", position="end", x=50.0))[0]
    assert [a + b for a, b in zip(front, end)] == [0.0] * 10
    assert out(catalog.apply(c, "ZeroBitCollusionAttack", original="original", x=0.0))[0] == list(map(float, range(10)))


def test_flips_keep_samples(spark):
    c = clip(spark, range(64))
    got = out(catalog.apply(c, "FlipSamplesAttack", num_flips=8, flip_duration=0.003))[0]
    assert sorted(got) == list(map(float, range(64))) and got != list(map(float, range(64)))


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.0, 1.0], [1.0, 1.0, 1.0]), ([1.0, 0.0], None), ([1.0, 0.0], [1.0, None])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(metrics.accuracy(F.col("a"), F.col("b"))).collect()] == [66.666667, 50.0, 50.0]
    same = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0, 3.0], [1.0])], "a array<double>, b array<double>")
    rows = same.select(metrics.snr(F.col("a"), F.col("b")).alias("s"), metrics.psnr(F.col("a"), F.col("b")).alias("p")).collect()
    assert rows[0].s == math.inf and rows[0].p == math.inf and rows[1].s is None
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0, 0.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>").select(metrics.accuracy(F.col("a"), F.col("b"))).collect()


def test_bits(spark):
    df = spark.createDataFrame([([1, 0, 1, 0, 0, 0, 0, 1, 1, 1],)], "b array<int>")
    r = df.select(bits.pack(F.col("b")).alias("p"), bits.unpack(F.array(F.lit(161), F.lit(3))).alias("u")).first()
    assert r.p == [161, 3] and r.u == [1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1]


def test_model_without_attack_and_inverted(spark):
    e = C.embedding_clips(C.table(spark, "/root/testdata/sf0.001", "embeddings")).limit(50)
    with pytest.warns(UserWarning, match="Unknown"):
        results = benchmark.run(e, attack_types=["SignInversionAttack", "SameModelAttack", "Unknown"])
    stats = {r.attack: r.accuracy_mean for r in benchmark.mean_accuracy(results).collect()}
    assert stats["SignInversionAttack"] == 0.0 and set(stats) == {"SignInversionAttack", "SameModelAttack"}
    plain = catalog.bind(e, "audio", SPREAD_A.embed(F.col("audio"), bits.message("m", 16)))
    assert plain.select(metrics.accuracy(bits.message("m", 16).cast("array<double>"), SPREAD_A.detect(F.col("audio"))).alias("a")).agg(F.min("a")).first()[0] == 100.0


def test_report(spark):
    stats = spark.createDataFrame([("STFTQuantizationAttack", 1, 96.0, None), ("EchoAttack", 1, 71.0, None)], "attack string, n long, accuracy_mean double, accuracy_cross_model_mean double")
    rows = report.report_rows(stats).collect()
    assert [(r["name"], r["accuracy"], r["band"]) for r in rows] == [("Echo", "71.00", "fair"), ("S T F T Quantization", "96.00", "excellent")]
    assert report.overall_mean(stats).first()[0] == 83.5
    assert "Mean accuracy: 83.50" in report.latex(stats)
    assert report.overall_mean(stats.limit(0)).first()[0] == 0.0


def test_wav_round_trip(spark, tmp_path):
    from tremolo.sources import files

    x = [0.0, 0.5, -0.5, 0.25]
    (tmp_path / "a.WAV").write_bytes(files.encode_wav(x, 16000))
    (tmp_path / "b.txt").write_bytes(b"no")
    r = files.read_clips(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].error is None and r[0].sampling_rate == 16000 and max(abs(a - b) for a, b in zip(r[0].audio, x)) < 1e-4
    made = files.write_clips(files.read_clips(spark, str(tmp_path)), str(tmp_path / "out"), "attacked").collect()
    assert [m["name"] for m in made] == ["a_attacked.wav"]
    for name, content in (("c.wav", b"RIFF"), ("d.wav", b"no wav at all"), ("e.mp3", b"x")):
        (tmp_path / name).write_bytes(content)
    bad = {x.clip_id: x for x in files.read_clips(spark, str(tmp_path)).collect()}
    assert sorted(bad) == ["a.WAV", "c.wav", "d.wav", "e.mp3"] and bad["a.WAV"].error is None
    assert all(bad[x].error and bad[x].audio is None for x in ("c.wav", "d.wav", "e.mp3"))
    with pytest.raises(FileNotFoundError):
        files.read_config(str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        files.read_config(str(tmp_path / "b.txt"))


def _echo_service(url, payload, timeout):
    if url.endswith("/embed"):
        return {"watermarked_audio": payload["audio"]}
    if url.endswith("/detect"):
        return {"watermark": 0.5 if len(payload["audio"]) == 1 else [1, 0]}
    return {"audio": payload["audio"]} if "attack" in url and "broken" not in url else {}


def test_remote(spark):
    from tremolo.sources.remote import RemoteAttack, RemoteModel, neural_attacks

    c = clip(spark, [0.1, 0.2, 0.3], [0.4]).withColumn("bits", F.array(F.lit(1), F.lit(0)))
    m = RemoteModel("M", "http://x", 16000, 2, transport=_echo_service)
    assert [r.audio for r in m.embed(c).orderBy("clip_id").collect()] == [[0.1, 0.2, 0.3], [0.4]]
    got = m.detect(c).orderBy("clip_id").collect()
    assert got[0].detected == [1.0, 0.0] and got[1].detected is None and got[1].score == 0.5
    assert [len(r.audio) for r in RemoteAttack("A", "http://x", multiple=2, transport=_echo_service)(c).orderBy("clip_id").collect()] == [2, 0]
    # 5 samples are cut to 4 at their own rate and come back as 4
    five = clip(spark, [0.1, 0.2, 0.3, 0.4, 0.5])
    assert [len(r.audio) for r in RemoteAttack("A", "http://x", 48000, 4, transport=_echo_service)(five).collect()] == [4]
    with pytest.raises(Exception, match="no audio"):
        RemoteAttack("A", "http://broken", transport=_echo_service)(c).collect()
    with pytest.raises(ValueError):
        neural_attacks()["DiffusionAttack"](c, diffusion_steps=151)


def test_services_in_a_run(spark, monkeypatch):
    from tremolo.sources.remote import register_services

    def service(url, payload, timeout):
        assert payload["sampling_rate"] in (16000, 48000, 44100)
        if url.endswith("/embed"):
            return {"watermarked_audio": payload["audio"]}
        if url.endswith("/detect"):
            return {"watermark": 0.25 if "perth" in url.lower() else [1.0] * 16}
        return {"audio": payload["audio"]}

    monkeypatch.setattr(catalog, "ATTACKS", dict(catalog.ATTACKS))
    monkeypatch.setattr(catalog, "MODELS", dict(catalog.MODELS))
    register_services("http://x", transport=service)
    c = clip(spark, [0.1, -0.2] * 1500)
    ones = F.array_repeat(F.lit(1), 16)
    for name, want in (("AudioSealModel", 100.0), ("PerthModel", 0.25)):
        got = benchmark.run(c, name, ["VAEAttack", "SpeechEnhancementAttack", "SignInversionAttack"], bits=ones).collect()
        assert {r.attack: r.accuracy for r in got} == {"VAEAttack": want, "SpeechEnhancementAttack": want, "SignInversionAttack": want}
    with pytest.raises(ValueError, match="at most"):
        benchmark.run(c, "AudioSealModel", ["DiffusionAttack"], params={"DiffusionAttack": {"diffusion_steps": 151}})
    assert "VAEAttack" not in catalog.choose(None)[0]


def test_run_is_at_the_models_rate(spark):
    c = clip(spark, [0.1, -0.2] * 400, rate=8000)
    seen = benchmark.run(c, "SpreadA", ["SignInversionAttack"])
    assert "go(" in seen._jdf.queryExecution().toString() and seen.count() == 1
    plain = benchmark.run(clip(spark, [0.1, -0.2] * 400).withColumn("sampling_rate", F.lit(16000)), "SpreadA", ["SignInversionAttack"])
    assert "ArrowEvalPython" not in plain._jdf.queryExecution().executedPlan().toString()


def test_filters_of_unlike_lengths(spark):
    import numpy as np

    from tremolo.functions import dsp

    rng = np.random.default_rng(3)
    xs = [rng.normal(size=n) for n in (1, 2, 37, 40, 63, 64, 200)]
    low = dsp.polynomials(kernels.filter_for("lowpass", 5000.0, 5, 16000))
    for got, x in zip(out(catalog.apply(clip(spark, *xs), "LowpassFilterAttack")), xs):
        assert np.allclose(got, dsp.iir(*low, x)[0], rtol=0, atol=1e-12)
    for got, x in zip(out(catalog.apply(clip(spark, *xs), "EqualizerAttack")), xs):
        y = x[None]
        for b, a in kernels.equalizer_stages([10, 10, 10, 10, 0, 0, -5, -10], 16000):
            y = y + dsp.iir(b, a, y)
        assert np.allclose(got, y[0] / np.abs(y).max())


def test_block_distances_are_those_of_the_attack(spark):
    import numpy as np

    from tremolo.functions.psychoacoustics import MaskingModel
    from tremolo.operators import blocks

    x, size, hop = np.random.default_rng(4).normal(size=160), 32, 8
    f = C.frames(clip(spark, x), size, hop)
    each = {r.m: np.abs(np.fft.fft(r.block)) for r in f.collect()}
    got = {(r.m, r.other): r.dist for r in blocks.distances(blocks.spectra(f, size), 4).collect()}
    want = {(i, j): np.linalg.norm(each[i] - each[j]) for i in each for j in each if abs(i - j) > 4}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    half = {i: s[: size // 2 + 1] for i, s in each.items()}
    t = {i: MaskingModel(size, 16000).threshold(s)[0] for i, s in half.items()}
    want = {(i, j): np.linalg.norm(half[i] * (half[i] > t[i]) - half[j] * (half[j] > np.maximum(t[i], t[j]))) for i, j in want}
    got = {(r.m, r.other): r.dist for r in blocks.distances(blocks.spectra(f, size, 16000), 4, masked=True).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_stream_of_chunks_equals_whole(spark, tmp_path):
    import numpy as np

    from tremolo.functions import dsp
    from tremolo.streaming.running import filtered

    x = np.random.default_rng(0).normal(size=30)
    rows = [(1, k, x[10 * k : 10 * k + 10].tolist()) for k in range(3)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "clip_id long, seq long, audio array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    b, a = dsp.polynomials(dsp.butter(2, 0.3, "lowpass"))
    stream = spark.readStream.schema("clip_id long, seq long, audio array<double>").parquet(str(tmp_path / "in"))
    q = filtered(stream, b, a).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = np.concatenate([r.audio for r in spark.table("chunks").orderBy("seq").collect()])
    assert np.allclose(got, dsp.iir(b, a, x)[0])


def test_ear_curves_and_filters():
    from tremolo.functions import psychoacoustics as bark

    for name, (hz, level) in bark.CURVES.items():
        assert np.allclose(bark.ear_level(np.array(hz), name), level)
        at, step = np.array(hz[1:-1], float), 0.02
        f = lambda x: bark.ear_level(x, name)  # noqa: B023, E731
        left, right = (f(at) - 2 * f(at + t * step) + f(at + 2 * t * step) for t in (-1, 1))
        assert np.allclose(left, right, atol=2e-2 * np.abs(left).max())  # second derivatives agree on both sides of a point
        assert bark.ear_level(np.array([0.0, 9e4]), name).tolist() == [level[0], level[-1]]
    for rate, curve in ((16000, "ELC"), (16000, "MAP"), (32000, "MAF")):
        taps = bark.ear_taps(1024, rate, curve)
        assert np.allclose(taps, taps[::-1])  # linear phase
        k = np.arange(40, 480)
        gain = np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(1024)) / 1024) @ taps)
        want = 10 ** (-bark.ear_level(k * rate / 1024, curve) / 10)
        assert np.allclose(10 * np.log10(gain), 10 * np.log10(want), atol=1.0)
        w = bark.ear_weights(1024, rate, curve)
        assert w.max() == 1 and np.allclose(w[k], gain / gain.max() * w[k].max())
    with pytest.raises(ValueError):
        bark.ear_taps(1023, 16000)
    with pytest.raises(ValueError):
        bark.ear_level(np.array([1.0]), "ABC")


def plain_nmr(x, y, rate, size, hop):
    """Block by block, band by band."""
    from tremolo.functions import psychoacoustics as bark

    bands, step, w, h = bark.fractional_bands(), rate / size, [0.5 - 0.5 * np.cos(2 * np.pi * (j + 1) / (size + 1)) for j in range(size)], bark.ear_taps(size, rate)
    share = [[max(0.0, min(hi, (k + 0.5) * step) - max(lo, (k - 0.5) * step)) / step for k in range(size // 2 + 1)] for _, lo, hi in bands]
    ear = [abs(sum(h[j] * np.exp(-2j * np.pi * j * k / size) for j in range(size))) for k in range(size // 2 + 1)]
    errors = []
    for at in range(0, max(len(x) - size, 0) + hop, hop):
        if at and at - hop + size >= len(x):
            break
        a, b = (np.abs(np.fft.rfft([(v[at + j] if at + j < len(v) else 0.0) * w[j] for j in range(size)])) for v in (x, y))
        level = [sum(s * v for s, v in zip(row, a)) for row in share]
        limit = [sum((v * bark.TONE * (bark.UPPER if m < n else bark.LOWER) ** abs(m - n)) ** 0.9 for m, v in enumerate(level) if m != n) ** (1 / 0.9) for n in range(109)]
        error = 0.0
        for k in range(size // 2 + 1):
            if any(row[k] for row in share):
                t = sum(row[k] * limit[n] / sum(row) ** 0.5 for n, row in enumerate(share) if row[k])
                error += (a[k] - b[k]) ** 2 * ear[k] / max(ear) / (t + np.finfo(float).eps)
        errors.append(error)
    return 10 * np.log10(sum(errors) / len(errors) / 109)


def test_noise_to_mask(spark):
    from tremolo.functions.psychoacoustics import noise_to_mask
    from tremolo.plans.benchmark import nmr

    rng = np.random.default_rng(4)
    for n in (1, 64, 65, 200):
        x = rng.normal(size=n)
        y = x + rng.normal(size=n) * 0.1
        assert noise_to_mask(x, y, 16000, 64, 16) == pytest.approx(plain_nmr(x, y, 16000, 64, 16), abs=1e-8)
    x = rng.normal(size=3000)
    quiet, loud = (noise_to_mask(x, x + rng.normal(size=3000) * a, 16000) for a in (1e-4, 1e-1))
    assert quiet < -9 < loud
    assert noise_to_mask(x, x, 16000) is None and noise_to_mask(x, [], 16000) is None
    rows = spark.createDataFrame([(1, x.tolist(), (x + 0.01).tolist()), (2, None, [1.0]), (3, [1.0], None), (4, [], [])], "clip_id int, a array<double>, b array<double>")
    got = {r.clip_id: r.v for r in rows.select("clip_id", nmr(F.col("a"), F.col("b"), F.lit(16000)).alias("v")).collect()}
    assert got[1] == pytest.approx(noise_to_mask(x, x + 0.01, 16000)) and got[2] is got[3] is got[4] is None


def test_clips_gathered_from_samples(spark):
    from tremolo.sources.clips import _lists
    import pyarrow as pa

    want = [(None, [1.0, None]), (1, [float(v) for v in range(7)]), (2, [5.0]), (3, [6.0, 7.0]), (4, [8.0])]
    flat = [(k, v) for k, x in want for v in x]
    for size in range(1, len(flat) + 1):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat[i : i + size]], pa.int64()), pa.array([r[1] for r in flat[i : i + size]], pa.float64())], ["clip_id", "x"]) for i in range(0, len(flat), size)]
        got = [r for b in _lists(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
        assert [(r["clip_id"], r["audio"]) for r in got] == want
    rows = spark.createDataFrame([(k, i, v) for k, x in want for i, v in reversed(list(enumerate(x)))], "clip_id long, i int, x double")
    clips = C.from_samples(rows)
    assert {r.clip_id: r.audio for r in clips.collect()} == dict(want)
    # samples are sorted as rows: no list of structs is collected and sorted
    assert "collect_list" not in clips._jdf.queryExecution().optimizedPlan().toString()
