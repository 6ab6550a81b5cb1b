import numpy as np
import pytest

from tremolo.functions import dsp
from tremolo.operators.kernels import biquad


@pytest.mark.parametrize("kind,at", [("lowpass", 0.0), ("highpass", np.pi)])
def test_butterworth_gains(kind, at):
    b, a = dsp.polynomials(dsp.butter(5, 0.3, kind))
    assert abs(abs(dsp.response(b, a, np.array([at]))[0]) - 1) < 1e-9
    assert abs(abs(dsp.response(b, a, np.array([0.3 * np.pi]))[0]) - 2**-0.5) < 1e-9


def test_bandstop_sections():
    parts = dsp.sections(dsp.butter(4, (200 / 8000, 300 / 8000), "bandstop"))

    def gain(f):
        return np.prod([abs(dsp.response(b, a, np.array([2 * np.pi * f / 16000]))[0]) for b, a in parts])

    assert abs(gain(0) - 1) < 1e-4 and abs(gain(200) - 2**-0.5) < 1e-4 and gain(245) < 1e-3


def test_zero_phase_keeps_constants():
    x = np.full(100, 3.0)
    parts = dsp.sections(dsp.butter(4, (0.2, 0.3), "bandstop"))
    assert np.allclose(dsp.zero_phase(parts, x, 27)[0], x, atol=1e-6)


def test_iir_carries_state_over_chunks():
    b, a = dsp.polynomials(dsp.butter(3, 0.4, "lowpass"))
    x = np.random.default_rng(0).normal(size=50)
    whole = dsp.iir(b, a, x)[0]
    memory, parts = np.zeros(3), []
    for c in (x[:20], x[20:23], x[23:]):
        y, memory = (v[0] for v in dsp.iir_with_state(b, a, c, memory[None]))
        parts.append(y)
    assert np.allclose(np.concatenate(parts), whole)


def test_burg_finds_a_model():
    rng, x = np.random.default_rng(1), np.zeros(4000)
    for n in range(2, 4000):
        x[n] = 1.5 * x[n - 1] - 0.8 * x[n - 2] + rng.normal()
    assert np.allclose(dsp.burg(x, 2), [1, -1.5, 0.8], atol=0.05)


def test_resampling_lengths_and_tone():
    x = np.sin(2 * np.pi * 50 * np.arange(1600) / 16000)
    assert len(dsp.resample(x, 16000, 22050)) == 2205
    y = dsp.resample(dsp.resample(x, 16000, 22050), 22050, 16000)
    assert np.abs(y - x)[100:-100].max() < 0.02
    q = dsp.poly_resample(dsp.poly_resample(x[:65], 1, 2, dsp.decimation_taps(2)), 2, 1)
    assert len(q) == 66


def test_spectra_round_trip():
    x = np.random.default_rng(2).normal(size=256)
    y = dsp.istft(dsp.stft(x, 32, 16), 32, 16)
    assert np.allclose(y[:256], x)


def test_haar_without_threshold_and_odd_length():
    x = np.random.default_rng(3).normal(size=64)
    assert np.allclose(dsp.wavelet_denoise(x, factor=0.0), x)
    assert len(dsp.wavelet_denoise(np.arange(65.0))) == 66
    with pytest.raises(ValueError):
        dsp.wavelet_denoise(x, "nope")


def test_blocks_alone_come_back():
    x = np.random.default_rng(4).normal(size=200)
    assert np.allclose(dsp.replace_blocks(x, 16, 4, -1.0, 5), x)


def test_stretch_length():
    x = np.sin(np.arange(4000) * 0.1)
    assert len(dsp.stretch(x, 1.4, 256)) == 5600
    assert len(dsp.shift_pitch(x, 1.0, 256)) == 4000


def test_shelf_is_identity_without_gain():
    b, a = biquad("LowShelf", 100.0, 50.0, 0.0, 16000.0)
    assert list(b) == [1, 0, 0] and list(a) == [1, 0, 0]
    with pytest.raises(ValueError):
        biquad("LowShelf", 9000.0, 50.0, 1.0, 16000.0)


def test_stoi_of_itself():
    x = np.random.default_rng(5).normal(size=16000)
    assert dsp.stoi(x, x, 16000) > 0.99
    assert dsp.stoi(x, np.random.default_rng(6).normal(size=16000), 16000) < 0.4
    assert dsp.stoi(x[:100], x[:100], 16000) is None


def by_sample(b, a, x, state):
    """Direct form II transposed, a sample at a time."""
    n = max(len(b), len(a))
    b, a, s, out = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a))), np.append(state, 0.0), []
    for v in x:
        y = b[0] * v + s[0]
        s[:-1] = s[1:] + v * b[1:] - y * a[1:]
        out.append(y)
    return np.array(out), s[:-1]


def test_blocked_filters_equal_the_loop():
    from tremolo.operators.kernels import PINK, equalizer_stages

    rng = np.random.default_rng(5)
    sharp = dsp.butter(4, 50 / 8000, "highpass")
    assert not dsp.blocked(*dsp.polynomials(sharp)).calm and all(dsp.blocked(b, a).calm for b, a in dsp.sections(sharp))
    designs = [dsp.polynomials(dsp.butter(5, 5000 / 8000, "lowpass")), dsp.polynomials(sharp), *dsp.sections(sharp), (np.array(PINK[0]), np.array(PINK[1])), *equalizer_stages([10, 10, 10, 10, 0, 0, -5, -10], 16000.0)[:3]]
    for b, a in designs:
        for n in (0, 1, 63, 64, 65, 1000, 160_000 if len(b) == 6 else 4096):
            x, state = rng.normal(size=n), rng.normal(size=len(a) - 1) * 0.1
            want, last = by_sample(b, a, x, state)
            got, end = dsp.iir_with_state(b, a, x, state)
            assert np.allclose(got[0], want, atol=1e-6 * max(1.0, np.abs(want).max(initial=0))) and np.allclose(end[0], last, atol=1e-6 * max(1.0, np.abs(last).max()))
    x = rng.normal(size=160_000)  # ten seconds
    want = by_sample(*dsp.polynomials(sharp), x, np.zeros(4))[0]
    assert np.allclose(dsp.cascade(dsp.sections(sharp), x)[0], want, atol=1e-7)


def test_fits_equal_least_squares():
    rng = np.random.default_rng(2)
    x, near = rng.normal(size=(5, 16)), rng.normal(size=(5, 4, 16))
    near[1, 2] = near[1, 0]  # dependent
    near[2, 1] = 0
    for block, basis, fit in zip(x, near, dsp.fit_blocks(x, near)):
        spectra = np.fft.fft(basis, axis=1).T
        want = spectra @ np.linalg.lstsq(spectra, np.fft.fft(block), rcond=None)[0]
        assert np.allclose(np.fft.fft(fit), want, atol=1e-9)


def by_tap(x, up, down, taps):
    """Zero-phase polyphase resampling, an output at a time."""
    half, out = len(taps) // 2, []
    for i in range(-(-len(x) * up // down)):
        out.append(sum(x[k] * taps[i * down + half - k * up] for k in range(len(x)) if 0 <= i * down + half - k * up < len(taps)))
    return np.array(out)


def test_resampling_equals_the_loop():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 63, 200):
        for up, down in ((32, 1), (1, 3), (8, 5), (5, 8), (147, 160), (1001, 1000)):
            x = rng.normal(size=n)
            assert np.allclose(dsp.poly_resample(x, up, down), by_tap(x, up, down, dsp.resampling_taps(up, down)), atol=1e-12)
    x[50] = np.nan  # reaches what its taps meet, no more
    assert 0 < np.isnan(dsp.poly_resample(x, 8, 5)).sum() < 50


def test_long_clips_are_resampled_and_scored_in_parts():
    import tracemalloc

    x = np.random.default_rng(8).normal(size=20_000)
    tracemalloc.start()
    y = dsp.resample(x, 500, 16000)  # 5 MB; every output's taps at once are over 100 MB, several times
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.reset_peak()
    assert dsp.stoi(y, y, 16000) > 0.99 and tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()


def test_clips_stretched_together_equal_each_alone():
    x = np.random.default_rng(9).normal(size=(5, 300))
    for go in (lambda v: dsp.stretch(v, 1.4, 64), lambda v: dsp.stretch(v, 0.5, 64), lambda v: dsp.shift_pitch(v, 1.0, 64)):
        many = go(x)
        assert all(np.array_equal(many[i], go(x[i])) for i in range(5))
