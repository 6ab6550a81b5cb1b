"""Range joins, filters in blocks and block replacement by relational steps, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import by_sample
from tremolo.functions import dsp
from tremolo.operators import blocks, catalog
from tremolo.operators.intervals import overlaps, range_join
from tremolo.operators.scan import filter_blocks, sample_blocks
from tremolo.plans import queries
from tremolo.sources import clips as C

SF = "/root/testdata/sf0.001"


def test_range_join_whatever_the_buckets(spark):
    places = [(c, i, i * 0.5) for c in (1, 2, None) for i in range(60)] + [(1, 7, -1.0), (1, None, 0.0)]
    cuts = [(1, 0, 5, "a"), (1, 3, 50, "b"), (1, 3, 50, "b"), (1, 9, 9, "empty"), (1, 9, 4, "back"), (2, -4, 2, "early"), (2, 58, 90, "late"), (3, 0, 9, "none"), (2, None, 9, "null"), (None, 0, 60, "no clip")]
    p, q = spark.createDataFrame(places, "clip_id int, i int, x double"), spark.createDataFrame(cuts, "clip_id int, start int, stop int, name string")
    want = sorted((c, i, x, n) for c, i, x in places for d, s, e, n in cuts if c is not None and c == d and None not in (i, s, e) and s <= i < e)
    for width in (1, 3, 8, 1000):
        assert sorted(map(tuple, range_join(p, q, width).select("clip_id", "i", "x", "name").collect())) == want
        kept = range_join(p, q, width, "left_anti")
        assert kept.columns == p.columns and kept.count() == len(places) - len({(c, i, x) for c, i, x, _ in want})
    assert range_join(p, q.where("false"), 4).count() == 0 and range_join(p.where("false"), q, 4, "left").count() == 0
    with pytest.raises(ValueError):
        range_join(p, q, 0)


def test_overlaps(spark):
    rng = np.random.default_rng(1)
    a = [(k, float(x), float(x + w)) for k, (x, w) in enumerate(zip(rng.uniform(0, 50, 40), rng.uniform(-1, 6, 40)))]
    b = [(k, float(x), float(x + w)) for k, (x, w) in enumerate(zip(rng.uniform(0, 50, 30), rng.uniform(0, 20, 30)))]
    want = {(i, j): min(h, t) - max(lo, f) for i, lo, h in a for j, f, t in b if lo < h and min(h, t) > max(lo, f)}
    for width in (0.7, 5.0, 500.0):
        got = overlaps(spark.createDataFrame(a, "k int, low double, high double"), spark.createDataFrame(b, "j int, `from` double, `to` double"), width).collect()
        assert {(r.k, r.j): pytest.approx(r.overlap) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("size", [1, 16, 100])
def test_blocks_of_a_clip_filtered_apart(spark, size):
    rng = np.random.default_rng(size)
    clips = {1: rng.normal(size=333), 2: rng.normal(size=16), 3: rng.normal(size=1), 4: rng.normal(size=100)}
    rows = spark.createDataFrame([(c, i, float(v)) for c, x in clips.items() for i, v in enumerate(x)], "clip_id long, i int, x double").repartition(3)
    for b, a in (dsp.polynomials(dsp.butter(5, 5000 / 8000, "lowpass")), dsp.sections(dsp.butter(4, 50 / 8000, "highpass"))[0]):
        got = {c: [] for c in clips}
        for r in sorted(filter_blocks(sample_blocks(rows, size), b, a, size).collect(), key=lambda r: r.block):
            got[r.clip_id] += r.audio
        for c, x in clips.items():
            assert np.allclose(got[c], by_sample(b, a, x, np.zeros(len(a) - 1))[0], atol=1e-9)
    with pytest.raises(ValueError):
        filter_blocks(sample_blocks(rows, 64), *dsp.polynomials(dsp.butter(4, 50 / 8000, "highpass")), 64)


def plain_replacement(x, size, hop, upper, k):
    """The attack of one clip, block by block, and how many blocks it replaced."""
    count = max(0, -(-(len(x) - size) // hop)) + 1
    y = np.pad(x, (0, count * hop + size - len(x)))
    w = dsp.hann_open(size)
    spectra = [np.fft.fft(y[m * hop : m * hop + size] * w) for m in range(count)]
    out, changed = [], 0
    for m, s in enumerate(spectra):
        far = [o for o in range(count) if abs(o - m) > size // hop]
        dist = [np.linalg.norm(np.abs(s) - np.abs(spectra[o])) for o in far]
        near = [spectra[o] for o, d in zip(far, dist) if d <= upper][:k]
        if near:
            basis = np.array(near).T
            fit = basis @ np.linalg.lstsq(basis, s, rcond=None)[0]
            if np.linalg.norm(np.abs(s) - np.abs(fit)) <= min(dist):
                s, changed = fit, changed + 1
        out.append(np.real(np.fft.ifft(s)) * w)
    total, norm = np.zeros((count - 1) * hop + size), np.zeros((count - 1) * hop + size)
    for m, b in enumerate(out):
        total[m * hop : m * hop + size] += b
        norm[m * hop : m * hop + size] += w * w
    return (total / norm)[: len(x)], changed, count


def test_replacement_by_steps_and_by_kernel(spark):
    e = C.embedding_clips(spark.read.parquet(f"{SF}/embeddings.parquet")).where("clip_id < 40")
    f = C.frames(e, 16, 4)
    dist = blocks.distances(blocks.spectra(f, 16), 4)
    fitted = blocks.fits(f, blocks.first_k(blocks.candidates(dist, 2.0), 8), blocks.nearest(dist), 16)
    done = blocks.replaced(f, fitted)
    steps = {}
    for r in blocks.overlap_add(done, 16, 4).collect():
        steps.setdefault(r.clip_id, {})[r.i] = r.x
    share = {r.clip_id: r for r in blocks.replaced_share(done).collect()}
    kernel = {r.clip_id: r.audio for r in catalog.apply(e, "ReplacementAttack", replacement_block_size=16, replacement_upper_bound=2.0, k=8).collect()}
    some = 0
    for r in e.collect():
        want, changed, count = plain_replacement(np.array(r.audio), 16, 4, 2.0, 8)
        assert np.allclose(kernel[r.clip_id], want, atol=1e-8)
        assert np.allclose([steps[r.clip_id][i] for i in range(len(want))], want, atol=1e-8)
        assert (share[r.clip_id].n_blocks, share[r.clip_id].n_replaced) == (count, changed) and share[r.clip_id].per_cent == pytest.approx(100 * changed / count)
        some += changed
    assert some


def test_masked_fits(spark):
    e = C.embedding_clips(spark.read.parquet(f"{SF}/embeddings.parquet")).where("clip_id < 5")
    f = C.frames(e, 16, 4)
    dist = blocks.distances(blocks.spectra(f, 16, C.RATE), 4, masked=True)
    done = blocks.replaced(f, blocks.fits(f, blocks.first_k(blocks.candidates(dist, 2.0), 8), blocks.nearest(dist), 16, C.RATE))
    steps = {(r.clip_id, r.i): r.x for r in blocks.overlap_add(done, 16, 4).collect()}
    for r in catalog.apply(e, "ReplacementAttack", replacement_block_size=16, replacement_upper_bound=2.0, k=8, replacement_use_masking=True).collect():
        assert np.allclose([steps[r.clip_id, i] for i in range(len(r.audio))], r.audio, atol=1e-8)


def test_fractional_bands_fill_the_range():
    from tremolo.functions.psychoacoustics import fractional_bands

    bands = fractional_bands()
    assert len(bands) == 109 and bands[0][1] == pytest.approx(80) and bands[-1][2] == 18000 and all(a[2] == b[1] for a, b in zip(bands, bands[1:]))


def test_fractional_levels_keep_what_lies_in_the_bands(spark):
    levels = queries.fractional_band_levels(spark, SF).groupBy("clip_id", "m").agg(F.sum("level").alias("level"))
    s = queries.stft_magnitude(spark, SF)
    share = F.when(F.col("k") == 0, 0.42).when(F.col("k") == 8, 1.0).otherwise(1.0)  # bin 0 lies in the bands from 80 to 500 Hz
    want = s.groupBy("clip_id", "m").agg(F.sum(F.col("magnitude") * share).alias("want"))
    assert levels.join(want, ["clip_id", "m"]).where(F.abs(F.col("level") - F.col("want")) > 1e-4).count() == 0


@pytest.mark.parametrize("hop", [1, 3, 5, 8, 11, 16])
def test_least_squares_synthesis(hop):
    from tremolo.functions import dsp

    size, rng = 16, np.random.default_rng(hop)
    w = rng.uniform(0.1, 1, size)
    v, x = dsp.synthesis_window(w, hop), rng.normal(size=size + 12 * hop)
    y, wild, normal = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for at in range(0, len(x) - size + 1, hop):
        here = slice(at, at + size)
        y[here] += x[here] * w * v
        frame = rng.normal(size=size)  # frames that are no signal's: the nearest signal by its normal equations
        wild[here] += frame * v
        normal[here] += frame * w
    energy = sum(np.pad(w**2, (at, len(x) - size - at)) for at in range(0, len(x) - size + 1, hop))
    inner = slice(size, len(x) - size)
    assert np.allclose(y[inner], x[inner]) and np.allclose(wild[inner], (normal / energy)[inner])
    assert (dsp.synthesis_window(np.zeros(4), 2) == 0).all()
    with pytest.raises(ValueError):
        dsp.synthesis_window(w, size + 1)
