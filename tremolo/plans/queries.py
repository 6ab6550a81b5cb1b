"""Named queries of the signal engine over the test tables, each through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.functions import bits, metrics
from tremolo.functions import psychoacoustics as bark
from tremolo.functions.arrays import clean, positions, total
from tremolo.operators import attacks, blocks, catalog, kernels
from tremolo.operators.models import SPREAD_A, SPREAD_B
from tremolo.plans import benchmark, report
from tremolo.sources import clips as C
from tremolo.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Scaled-down parameters, as the test clips are short.
SMALL = {"size": 16, "hop": 4, "band": 4}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _e(spark: SparkSession, d: str) -> DataFrame:
    return C.embedding_clips(C.spread(C.table(spark, d, "embeddings")))


def _long(clips: DataFrame, digits: int = 9) -> DataFrame:
    return C.to_samples(clips).select("clip_id", "i", clean(F.col("x"), digits).alias("y"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Clips with one message for the run, their original and the marked audio."""
    e = _e(spark, d).withColumn("original", F.col("audio")).withColumn("bits", bits.message("7:message", 16))
    return catalog.bind(e, "audio", SPREAD_A.embed(F.col("original"), F.col("bits")))


def _plain_attack(key: str, name: str, digits: int = 9, **params) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _long(catalog.apply(_e(spark, d), name, **params), digits)

    run.__name__ = key
    query(run)


def _marked_attack(key: str, name: str, digits: int = 9, **params) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _long(catalog.apply(_marked(spark, d), name, model=SPREAD_A, original="original", **params), digits)

    run.__name__ = key
    query(run)


for _key, _name, _params in (
    ("atk_sign_inversion", "SignInversionAttack", {}),
    ("atk_pcm_8", "PCMQuantizationAttack", {"pcm": 8}),
    ("atk_pcm_16", "PCMQuantizationAttack", {"pcm": 16}),
    ("atk_pcm_24", "PCMQuantizationAttack", {"pcm": 24}),
    ("atk_quantization", "QuantizationAttack", {}),
    ("atk_smoothing", "SmoothingAttack", {}),
    ("atk_lowpass", "LowpassFilterAttack", {}),
    ("atk_highpass", "HighpassFilterAttack", {}),
    ("atk_bandstop", "BandstopFilterAttack", {}),
    ("atk_lpc", "LPCAttack", {"order": 2}),
    ("atk_chorus", "ChorusAttack", {"start_delays": [0.0005, 0.001, 0.002], "w_delays": [0.0002, 0.0002, 0.0002], "delay_rates": [200.0, 120.0, 120.0], "chorus_gains": [0.3, 0.2, 0.1]}),
    ("atk_flanger", "FlangerAttack", {"start_delay": 0.0005, "w_delay": 0.0002, "delay_rate": 250.0, "gain": 0.7}),
    ("atk_equalizer", "EqualizerAttack", {}),
    ("atk_resampling", "ResamplingPolyAttack", {"down_factor": 2}),
    ("atk_stft_quant", "STFTQuantizationAttack", {"n_fft": 16, "hop_length": 8, "quantization_levels": 64}),
    ("atk_wavelet_haar", "WaveletAttack", {}),
    ("atk_time_stretch", "TimeStretchAttack", {}),
    ("atk_inverted_time_stretch", "InvertedTimeStretch", {}),
    ("atk_pitch_shift", "PitchShiftAttack", {"cents": 100.0}),
    ("atk_additive_noise", "AdditiveNoiseAttack", {}),
    ("atk_gaussian_noise", "GaussianNoiseAttack", {}),
    ("atk_pink_noise", "PinkNoiseAttack", {}),
    ("atk_echo", "EchoAttack", {"duration_range": [0.0002, 0.002]}),
    ("atk_cut_samples", "CutSamplesAttack", {"cut_duration": 0.003, "cut_max_sequence_length": 4, "cut_num_sequences": 6}),
    ("atk_flip_samples", "FlipSamplesAttack", {"num_flips": 8, "flip_duration": 0.003}),
    ("atk_zero_cross_inserts", "ZeroCrossInsertsAttack", {"zero_cross_pause_length": 3, "zero_cross_min_distance": 0.0005}),
    ("atk_replacement", "ReplacementAttack", {"replacement_block_size": 16, "replacement_upper_bound": 2.0, "k": 8}),
    ("atk_replacement_masked", "ReplacementAttack", {"replacement_block_size": 16, "replacement_upper_bound": 2.0, "k": 8, "replacement_use_masking": True}),
):
    _plain_attack(_key, _name, 6 if _key in ("atk_lpc", "atk_highpass", "atk_bandstop") else 9, **_params)
for _key, _name, _params in (
    ("atk_zero_bit_collusion_front", "ZeroBitCollusionAttack", {"position": "front"}),
    ("atk_zero_bit_collusion_end", "ZeroBitCollusionAttack", {"position": "end"}),
    ("atk_zero_bit_collusion_random", "ZeroBitCollusionAttack", {"position": "random"}),
    ("atk_collusion", "CollusionAttack", {}),
    ("atk_same_model", "SameModelAttack", {}),
    ("atk_cross_model", "CrossModelAttack", {}),
):
    _marked_attack(_key, _name, **_params)


@query
def universal_threshold(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), (F.floor(F.size("audio") / 2) - 1).cast("int")), lambda k: (F.get("audio", k * 2) - F.get("audio", k * 2 + 1)) / F.sqrt(F.lit(2.0)))
    return _e(spark, d).select("clip_id", clean(attacks.haar_threshold(pairs, F.size("audio"), 0.5)).alias("threshold"))


@query
def zero_crossings(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("clip_id", F.explode(attacks.crossings(F.col("audio"))).alias("i"))


@query
def smoothing_long(spark: SparkSession, d: str) -> DataFrame:
    """The same moving mean in the long layout, over events: a window in each user's order."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip_id").orderBy("i").rowsBetween(-5, 4)
    return C.event_samples(C.table(spark, d, "events")).select("clip_id", "i", clean(F.sum("x").over(w) / 10, 6).alias("y"))


@query
def biquad_coeffs(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of every kind of biquad at 1 kHz, as the equalizer designs them."""
    rows = []
    for kind in ("LowPass", "HighPass", "BandPass", "AllPass", "Notch", "Peaking", "LowShelf", "HighShelf"):
        b, a = kernels.biquad(kind, 1000.0, 710.0, 6.0, 16000.0)
        rows.append((kind, *(round(float(v), 9) for v in (*b, a[1], a[2]))))
    return spark.createDataFrame(rows, "kind string, b0 double, b1 double, b2 double, a1 double, a2 double")


@query
def stft_magnitude(spark: SparkSession, d: str) -> DataFrame:
    """Magnitudes of windowed blocks by sums over sines and cosines."""
    import math

    f = C.frames(_e(spark, d), SMALL["size"], SMALL["hop"])
    part = lambda k, fn: F.aggregate(F.transform("block", lambda v, j: v * fn(F.lit(2 * math.pi / SMALL["size"]) * j * k)), F.lit(0.0), lambda s, x: s + x)
    f = f.select("clip_id", "m", "block", F.explode(F.sequence(F.lit(0), F.lit(SMALL["size"] // 2))).alias("k"))
    re, im = part(F.col("k"), F.cos), part(F.col("k"), F.sin)
    return f.select("clip_id", "m", "k", clean(F.sqrt(re * re + im * im), 8).alias("magnitude"))


@query
def frame_blocks(spark: SparkSession, d: str) -> DataFrame:
    f = C.frames(_e(spark, d), SMALL["size"], SMALL["hop"])
    return f.select("clip_id", "m", F.posexplode("block").alias("j", "v")).select("clip_id", "m", "j", clean(F.col("v")).alias("v"))


@query
def frame_samples(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each user's events by the table function, which gathers no clip."""
    from tremolo.functions.tables import frames_of

    f = frames_of(C.event_samples(C.table(spark, d, "events")), SMALL["size"], SMALL["hop"])
    return f.select("clip_id", "m", F.posexplode("block").alias("j", "v")).select("clip_id", "m", "j", clean(F.col("v"), 6).alias("v"))


def _distances(spark: SparkSession, d: str, masked: bool = False) -> DataFrame:
    """Distances of spectra, rounded, so that equal ones stay equal however they were summed."""
    f = C.frames(_e(spark, d), SMALL["size"], SMALL["hop"])
    got = blocks.distances(blocks.spectra(f, SMALL["size"], C.RATE if masked else None), SMALL["band"], masked)
    return got.withColumn("dist", clean(F.col("dist"), 8))


@query
def block_distance(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d)


@query
def block_distance_masked(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d, masked=True)


@query
def block_candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocks.candidates(_distances(spark, d), 1.0).groupBy("clip_id", "m").agg(F.count("*").alias("n"))


@query
def block_topk_first(spark: SparkSession, d: str) -> DataFrame:
    return blocks.first_k(blocks.candidates(_distances(spark, d), 1.0), 3).select("clip_id", "m", "other", "rank")


@query
def block_nearest(spark: SparkSession, d: str) -> DataFrame:
    return blocks.nearest(_distances(spark, d))


def _fitted(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of each clip, and the fits of those that have near ones from the first k of them."""
    f = C.frames(_e(spark, d), SMALL["size"], SMALL["hop"])
    dist = _distances(spark, d)
    return f, blocks.fits(f, blocks.first_k(blocks.candidates(dist, 1.0), k), blocks.nearest(dist), SMALL["size"])


@query
def block_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares fits from up to two near blocks, and whether they are kept."""
    fitted = _fitted(spark, d, 2)[1].withColumn("fit_dist", clean(F.col("fit_dist"), 6))
    return fitted.select("clip_id", "m", "n_used", "fit_dist", "best_dist", (F.col("fit_dist") <= F.col("best_dist")).alias("kept"))


@query
def replaced_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of blocks that fits from up to eight near ones replace, by clip."""
    return blocks.replaced_share(blocks.replaced(*_fitted(spark, d, 8)))


@query
def fractional_band_levels(spark: SparkSession, d: str) -> DataFrame:
    """Magnitudes of each block's spectrum dealt to the 109 bands by the share of a bin in each."""
    from tremolo.operators.intervals import overlaps

    step = C.RATE / SMALL["size"]
    bins = spark.range(SMALL["size"] // 2 + 1).select(F.col("id").cast("int").alias("k"), ((F.col("id") - 0.5) * step).alias("low"), ((F.col("id") + 0.5) * step).alias("high"))
    bands = spark.createDataFrame(bark.fractional_bands(), "band int, `from` double, `to` double")
    weights = overlaps(bins, bands, step).select("k", "band", (F.col("overlap") / step).alias("weight"))
    s = blocks.spectra(C.frames(_e(spark, d), SMALL["size"], SMALL["hop"]), SMALL["size"])
    inner = F.when((F.col("k") > 0) & (F.col("k") < SMALL["size"] // 2), F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0))
    s = s.select("clip_id", "m", F.posexplode("x").alias("k", "x")).withColumn("x", F.col("x") / inner)
    # At most one row for each bin and band that overlap.
    levels = s.join(F.broadcast(weights), "k").groupBy("clip_id", "m", "band").agg(F.sum(F.col("x") * F.col("weight")).alias("level"))
    return levels.select("clip_id", "m", "band", clean(F.col("level"), 8).alias("level"))


@query
def cut_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Samples of long clips inside cuts drawn for each clip, by a range join; some cuts overlap."""
    from tremolo.functions.rng import uniform
    from tremolo.operators.intervals import range_join

    s = C.event_samples(C.table(spark, d, "events"))
    n = s.groupBy("clip_id").agg(F.count("*").alias("n"))
    drawn = n.select("clip_id", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("nr"))
    drawn = drawn.withColumn("start", F.floor(uniform("3:cut", F.col("clip_id"), F.col("nr")) * F.col("n")))
    cuts = drawn.select("clip_id", "nr", "start", (F.col("start") + F.floor(uniform("3:length", F.col("clip_id"), F.col("nr")) * 7) + 1).alias("stop"))
    got = range_join(s, cuts, width=8)
    return got.groupBy("clip_id", "i").agg(F.count("*").alias("n_cuts"), F.min("nr").alias("first_cut"))


@query
def lowpass_long(spark: SparkSession, d: str) -> DataFrame:
    """The low pass over each user's events in blocks of 16, their states composed along the user."""
    from tremolo.functions import dsp
    from tremolo.operators.scan import filter_blocks, sample_blocks

    b, a = dsp.polynomials(dsp.butter(5, 5000 / (C.RATE / 2), "lowpass"))
    got = filter_blocks(sample_blocks(C.event_samples(C.table(spark, d, "events")), 16), b, a, 16)
    got = got.select("clip_id", "block", F.posexplode("audio").alias("j", "y"))
    return got.select("clip_id", (F.col("block") * 16 + F.col("j")).alias("i"), clean(F.col("y"), 6).alias("y"))


@query
def overlap_add(spark: SparkSession, d: str) -> DataFrame:
    """Unchanged blocks added up again give the clip back."""
    got = blocks.overlap_add(C.frames(_e(spark, d), SMALL["size"], SMALL["hop"]), SMALL["size"], SMALL["hop"])
    return got.select("clip_id", "i", clean(F.col("x"), 8).alias("y"))


@query
def hz_to_bark(spark: SparkSession, d: str) -> DataFrame:
    p = C.table(spark, d, "part")
    return p.select("p_partkey", clean(bark.hz_to_bark(F.col("p_retailprice"))).alias("bark"))


@query
def bark_to_hz(spark: SparkSession, d: str) -> DataFrame:
    p = C.table(spark, d, "part")
    return p.select("p_partkey", clean(bark.bark_to_hz(F.col("p_size") / 2), 6).alias("hz"))


@query
def bark_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of the bins of a 1024-point spectrum, their sizes and hearing limits."""
    k = spark.range(513).select(F.col("id").cast("int").alias("k"), bark.band_of_bin(F.col("id"), 1024, 16000, 24).alias("band"))
    step = 6 * __import__("math").asinh(8000 / 600) / 23
    return k.groupBy("band").agg(F.count("*").alias("n"), F.min("k").alias("first")).withColumn("limit_db", clean(bark.hearing_limit(F.col("band") * F.lit(step)), 6))


@query
def masking_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of eight bands, from the magnitudes of each eighth of a clip, summed."""
    level = lambda b: total(F.filter("audio", lambda x, i: F.floor(i * 8 / F.size("audio")) == b), F.abs)
    e = catalog.bind(_e(spark, d), "levels", F.transform(positions(F.lit(8)), level))
    return e.select("clip_id", F.posexplode(bark.masking(F.col("levels"), 8)).alias("band", "t")).select("clip_id", "band", clean(F.col("t")).alias("threshold"))


@query
def masking_threshold_frames(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of eight bands in every block of each clip, from its magnitudes summed by band."""
    import math

    size, bands = SMALL["size"], 8
    f = C.frames(_e(spark, d), size, SMALL["hop"])

    def magnitude(k):
        part = lambda fn: total(F.transform("block", lambda v, j: v * fn(F.lit(2 * math.pi / size) * j * k)))
        return F.sqrt(part(F.cos) * part(F.cos) + part(F.sin) * part(F.sin))

    f = catalog.bind(f, "spectrum", F.transform(positions(F.lit(size // 2 + 1)), magnitude))
    level = lambda b: total(F.transform("spectrum", lambda v, k: F.when(bark.band_of_bin(k, size, 16000, bands) == b, v).otherwise(F.lit(0.0))))
    f = catalog.bind(f, "levels", F.transform(positions(F.lit(bands)), level))
    return f.select("clip_id", "m", F.posexplode(bark.masking(F.col("levels"), bands)).alias("band", "t")).select("clip_id", "m", "band", clean(F.col("t"), 8).alias("threshold"))


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    """Long clips and what 8-bit codes leave of them."""
    clips = C.spread(C.lineitem_clips(C.table(spark, d, "lineitem"))).withColumn("original", F.col("audio"))
    return catalog.apply(clips, "PCMQuantizationAttack", pcm=8)


@query
def ear_weighted_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level of each block of 1024 samples of long clips behind the outer and middle ear, by the equal loudness curve."""
    weights = F.array(*(F.lit(float(v)) for v in bark.ear_weights(1024, C.RATE)))
    s = blocks.spectra(C.frames(C.spread(C.lineitem_clips(C.table(spark, d, "lineitem"))), 1024, 256), 1024)
    return s.select("clip_id", "m", clean(F.sqrt(total(F.zip_with("x", weights, lambda x, w: x * x * w * w))), 6).alias("level"))


@query
def metric_nmr(spark: SparkSession, d: str) -> DataFrame:
    """Noise that 8-bit codes add to long clips against what these mask, in blocks of 1024 samples over 109 bands."""
    c = _coarse(spark, d)
    return c.select("clip_id", clean(benchmark.nmr(F.col("original"), F.col("audio"), F.col("sampling_rate")), 5).alias("value"))


# Messages and metrics


@query
def watermark_bits(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).select("clip_id", F.posexplode(bits.message("7:message", 16, F.col("clip_id"))).alias("b", "bit"))
    return e


def _messages(spark: SparkSession, d: str, n: int = 16) -> DataFrame:
    return _e(spark, d).select("clip_id", bits.message("7:message", n, F.col("clip_id")).alias("bits"))


@query
def bits_pack(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d, 40).select("clip_id", F.posexplode(bits.pack(F.col("bits"))).alias("g", "value"))


@query
def bits_unpack(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d, 40).select("clip_id", F.posexplode(bits.unpack(bits.pack(F.col("bits")))).alias("b", "bit"))


@query
def bits_bipolar(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).select("clip_id", bits.bipolar(F.col("bits")).alias("v"))
    return m.select("clip_id", F.posexplode(F.arrays_zip("v", bits.decide(F.col("v")).alias("w"))).alias("b", "z")).select("clip_id", "b", F.col("z.v").alias("v"), F.col("z.w").alias("bit"))


@query
def compare_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Whole, missing and partly missing detections by clip number."""
    m = _messages(spark, d).withColumn("got", F.transform("bits", lambda b, i: F.when((F.col("clip_id") % 5 == 1) & (i == 3), None).otherwise(F.when((i + F.col("clip_id")) % 3 == 0, 1 - b).otherwise(b)).cast("double")))
    got = F.when(F.col("clip_id") % 5 == 0, F.lit(None).cast("array<double>")).otherwise(F.col("got"))
    return m.select("clip_id", clean(metrics.accuracy(F.col("bits").cast("array<double>"), got)).alias("accuracy"))


def _metric(spark: SparkSession, d: str, fn) -> DataFrame:
    return _marked(spark, d).select("clip_id", clean(fn(F.col("original"), F.col("audio")), 6).alias("value"))


@query
def metric_snr(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, metrics.snr)


@query
def metric_psnr(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, metrics.psnr)


@query
def metric_si_sdr(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, metrics.si_sdr)


@query
def metric_stoi(spark: SparkSession, d: str) -> DataFrame:
    """Intelligibility of noisy long clips, taken to be at 500 Hz so that they last long enough."""
    c = C.lineitem_clips(C.table(spark, d, "lineitem"), 500)
    noisy = catalog.apply(c.withColumn("original", F.col("audio")), "GaussianNoiseAttack", snr_db=10.0)
    return noisy.select("clip_id", benchmark.stoi(F.col("original"), F.col("audio"), F.col("sampling_rate")).alias("stoi"))


@query
def trim_match(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).withColumn("b", F.slice("audio", F.lit(1), (F.size("audio") - F.col("clip_id") % 7).cast("int")))
    x, y = metrics.trim(F.col("audio"), F.col("b"))
    return e.select("clip_id", F.size(x).alias("n"), F.size(y).alias("m"))


@query
def renormalize(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).withColumn("out", metrics.renormalize(F.col("audio"), F.transform("audio", lambda x: x * x * 3)))
    return _long(e.select("clip_id", F.col("out").alias("audio")))


@query
def resample_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Factors of up- and downsampling between rates: their quotients by the greatest common divisor."""
    import math

    rates = [8000, 16000, 22050, 24000, 44100, 48000]
    rows = [(a, b, b // math.gcd(a, b), a // math.gcd(a, b)) for a in rates for b in rates]
    return spark.createDataFrame(rows, "input int, target int, up int, down int")


@query
def resample_audio(spark: SparkSession, d: str) -> DataFrame:
    from tremolo.functions import dsp

    e = _e(spark, d)
    clip = catalog.Clip(F.col("clip_id"), F.col("audio"), F.col("sampling_rate"))
    return _long(e.select("clip_id", kernels.each(clip, lambda x, r: dsp.resample(x, r, 22050)).alias("audio")))


# Catalog, parameters, sources


@query
def scan_suffix_filter(spark: SparkSession, d: str) -> DataFrame:
    """The suffix filter of the directory scan, on urls, whose file names end in #top or /."""
    p = C.table(spark, d, "pages").select("page_id", "url")
    return p.select("page_id", files.has_audio_suffix(F.col("url")).alias("audio"), F.lower("url").rlike(r"(/|#top)$").alias("folder"))


@query
def wav_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Clips written as wav files of 16 bits to the shared folder and read back in segments of 16 samples."""
    import uuid

    from tremolo.sources import wav

    wav.register(spark)
    at = f"{files.shared_dir(spark)}/wav-{uuid.uuid4().hex}"
    _e(spark, d).write.format("wav").mode("append").save(at)
    got = spark.read.format("wav").option("segment", 16).load(at)
    got = got.select(files.stem(F.col("clip_id")).cast("long").alias("clip_id"), "block", F.posexplode("audio").alias("j", "y"))
    return got.select("clip_id", (F.col("block") * 16 + F.col("j")).alias("i"), clean(F.col("y")).alias("y"))


@query
def basename_stem(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "pages").select("page_id", files.stem(F.col("url")).alias("stem"))


@query
def json_params(spark: SparkSession, d: str) -> DataFrame:
    e = C.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query
def catalog_attacks(spark: SparkSession, d: str) -> DataFrame:
    return catalog.attack_table(spark).select("attack", "kind", F.to_json("params").alias("params"))


@query
def catalog_models(spark: SparkSession, d: str) -> DataFrame:
    return catalog.model_table(spark)


def _event_attacks(spark: SparkSession, d: str) -> DataFrame:
    """Requests as a table: a clip and the name of an attack, some of them unknown."""
    names = F.create_map(*(F.lit(x) for kv in {"click": "SignInversionAttack", "view": "SmoothingAttack", "error": "NoSuchAttack", "purchase": "EchoAttack"}.items() for x in kv))
    return C.table(spark, d, "events").select("event_id", F.coalesce(F.element_at(names, F.col("event_type")), F.lit("OtherAttack")).alias("attack"))


@query
def known_attacks_semi(spark: SparkSession, d: str) -> DataFrame:
    known = catalog.attack_table(spark).select("attack")
    return _event_attacks(spark, d).join(F.broadcast(known), "attack", "left_semi").select("event_id", "attack")


@query
def unknown_attacks_anti(spark: SparkSession, d: str) -> DataFrame:
    known = catalog.attack_table(spark).select("attack")
    return _event_attacks(spark, d).join(F.broadcast(known), "attack", "left_anti").groupBy("attack").agg(F.count("*").alias("n"))


@query
def attack_subset(spark: SparkSession, d: str) -> DataFrame:
    return _event_attacks(spark, d).where(F.col("attack").isin("SignInversionAttack", "EchoAttack")).groupBy("attack").agg(F.count("*").alias("n"))


@query
def param_merge(spark: SparkSession, d: str) -> DataFrame:
    """Defaults of three attacks with overrides of two; a null override counts as absent."""
    a = catalog.attack_table(spark).where(F.col("attack").isin("PCMQuantizationAttack", "GaussianNoiseAttack", "SmoothingAttack"))
    o = spark.createDataFrame([("PCMQuantizationAttack", {"pcm": "8"}), ("GaussianNoiseAttack", {"snr_db": None})], "attack string, params map<string,string>")
    return catalog.merged_params(a, o).select("attack", F.explode("params").alias("name", "value"))


@query
def model_rate_join(spark: SparkSession, d: str) -> DataFrame:
    """The clip's rate, or the model's where the clip has none."""
    e = _e(spark, d).select("clip_id", F.when(F.col("clip_id") % 2 == 0, F.lit(22050)).alias("given"), F.when(F.col("clip_id") % 3 == 0, "SpreadA").otherwise("SpreadB").alias("model"))
    return e.join(F.broadcast(catalog.model_table(spark)), "model").select("clip_id", F.coalesce("given", "sampling_rate").alias("rate"))


@query
def clip_attack_cross(spark: SparkSession, d: str) -> DataFrame:
    """Clips by attacks without a product join: the attacks are an array in each row."""
    names = F.array(*(F.lit(n) for n in ("EchoAttack", "SignInversionAttack", "SmoothingAttack")))
    return _e(spark, d).select("clip_id", F.explode(names).alias("attack"))


# The benchmark


def _bench(spark: SparkSession, d: str, names: list[str], **more) -> DataFrame:
    return benchmark.run(_e(spark, d), attack_types=names, params={"SmoothingAttack": {"window_size": 4}}, **more)


_SLICE = ["SignInversionAttack", "PCMQuantizationAttack", "SmoothingAttack", "GaussianNoiseAttack", "NoSuchAttack"]


@query
def bench_results(spark: SparkSession, d: str) -> DataFrame:
    r = _bench(spark, d, _SLICE)
    return r.select("clip_id", "attack", clean(F.col("accuracy")).alias("accuracy"), clean(F.col("snr"), 6).alias("snr"))


@query
def mean_accuracy(spark: SparkSession, d: str) -> DataFrame:
    stats = benchmark.mean_accuracy(_bench(spark, d, _SLICE))
    return stats.select("attack", "n", clean(F.col("accuracy_mean"), 6).alias("accuracy_mean")).orderBy("attack")


@query
def bench_cross_model(spark: SparkSession, d: str) -> DataFrame:
    stats = benchmark.mean_accuracy(_bench(spark, d, ["CrossModelAttack", "SameModelAttack", "CollusionAttack"]))
    return stats.select("attack", "n", clean(F.col("accuracy_mean"), 6).alias("accuracy_mean"), clean(F.col("accuracy_cross_model_mean"), 6).alias("accuracy_cross_model_mean"))


@query
def bench_full(spark: SparkSession, d: str) -> DataFrame:
    """Every attack that needs no service, with parameters that suit short clips."""
    small = {
        "STFTQuantizationAttack": {"n_fft": 16, "hop_length": 8}, "ReplacementAttack": {"replacement_block_size": 16, "k": 8},
        "CutSamplesAttack": {"cut_duration": 0.003, "cut_max_sequence_length": 4, "cut_num_sequences": 6}, "FlipSamplesAttack": {"num_flips": 8, "flip_duration": 0.003},
        "ZeroCrossInsertsAttack": {"zero_cross_pause_length": 3, "zero_cross_min_distance": 0.0005}, "EchoAttack": {"duration_range": [0.0002, 0.002]},
    }
    stats = benchmark.mean_accuracy(benchmark.run(_e(spark, d), params=small))
    return stats.select("attack", "n", clean(F.col("accuracy_mean"), 6).alias("accuracy_mean"))


@query
def bench_long(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark on long clips, gathered from lineitem."""
    clips = C.lineitem_clips(C.table(spark, d, "lineitem"))
    stats = benchmark.mean_accuracy(benchmark.run(clips, attack_types=["SignInversionAttack", "PCMQuantizationAttack", "QuantizationAttack", "LowpassFilterAttack", "ResamplingPolyAttack"]))
    return stats.select("attack", "n", clean(F.col("accuracy_mean"), 6).alias("accuracy_mean"))


@query
def bench_quality(spark: SparkSession, d: str) -> DataFrame:
    clips = C.lineitem_clips(C.table(spark, d, "lineitem"), 500)
    r = benchmark.run(clips, attack_types=["SignInversionAttack", "GaussianNoiseAttack"], quality=True, sampling_rate=500)
    return r.select("clip_id", "attack", "accuracy", "stoi", "pesq")


@query
def overall_mean(spark: SparkSession, d: str) -> DataFrame:
    got = report.overall_mean(benchmark.mean_accuracy(_bench(spark, d, _SLICE)))
    return got.select(clean(F.col("overall"), 6).alias("overall"))


@query
def accuracy_bands(spark: SparkSession, d: str) -> DataFrame:
    return report.accuracy_bands(benchmark.mean_accuracy(_bench(spark, d, _SLICE)))


@query
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.report_rows(benchmark.mean_accuracy(_bench(spark, d, _SLICE)))


@query
def display_name(spark: SparkSession, d: str) -> DataFrame:
    return _event_attacks(spark, d).select("event_id", report.display_name(F.col("attack")).alias("name"))


@query
def results_nested_json(spark: SparkSession, d: str) -> DataFrame:
    r = _bench(spark, d, ["SignInversionAttack", "PCMQuantizationAttack"])
    return report.nested_results(r.withColumn("snr", clean(F.col("snr"), 3)).withColumn("accuracy", clean(F.col("accuracy"), 6)))


# Streams: the state at the end of a stream over the whole table


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream until its input is used up and returns its rows, from Parquet in the shared folder.

    In mode complete each batch writes the whole result anew, so the last one stands.
    """
    import uuid

    at = f"{files.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    write = lambda rows, batch: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")
    out.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _table_stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    path = f"{d}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    utc = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    rows = _table_stream(spark, d, "events")
    return rows.withColumn("ts", utc) if dict(rows.dtypes)["ts"] == "timestamp_ntz" else rows


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    from tremolo.streaming.running import windowed_values

    return _drained(spark, windowed_values(_event_stream(spark, d), "1 day"), "complete").select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("start") / 86400).cast("int")).cast("string").alias("day"), "event_type", "n", clean(F.col("total"), 6).alias("total"))


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions, which end when nothing came for twelve hours."""
    from tremolo.streaming.running import session_values

    got = _drained(spark, session_values(_event_stream(spark, d), "12 hours"), "complete")
    return got.select(F.unix_micros("start").alias("start_us"), "user_id", "n", clean(F.col("total"), 6).alias("total"))


@query
def stream_running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    from tremolo.streaming.running import running_accuracy

    results = _event_stream(spark, d).select(F.col("event_type").alias("attack"), F.col("value").alias("accuracy"))
    return _drained(spark, running_accuracy(results), "complete").select("attack", "n", clean(F.col("accuracy_mean"), 6).alias("accuracy_mean"))


@query
def stream_chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    """Clips as a stream of chunks of 16 samples, the filter's memory and chunks that come early in state."""
    from tremolo.functions import dsp
    from tremolo.streaming.chunks import filtered_in_any_order, on_rocksdb

    n = 16
    clips = _table_stream(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<double>").alias("audio")).where(F.size("audio") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("audio") - 1) / n).cast("int")), lambda k: F.slice("audio", k * n + 1, n))
    chunks = clips.select("clip_id", F.posexplode(parts).alias("seq", "audio")).select("clip_id", F.col("seq").cast("long"), "audio", F.timestamp_seconds(F.lit(86400)).alias("ts"))  # the first watermark is 0 seconds
    with on_rocksdb(spark):
        out = _drained(spark, filtered_in_any_order(chunks.withWatermark("ts", "1 hour"), *dsp.polynomials(dsp.butter(2, 0.3, "lowpass"))), "append")
    return out.where("not late").select("clip_id", "seq", F.posexplode("audio").alias("i", "y")).select("clip_id", (F.col("seq") * n + F.col("i")).alias("i"), clean(F.col("y"), 6).alias("y"))


assert SPREAD_B.bits == SPREAD_A.bits
