"""Voice measures, resampling and alignment on signals whose truth is known."""

from __future__ import annotations

import numpy as np
import pytest

from tracemill.functions import signals
from tracemill.operators import aligner, features
from tracemill.sources import readers

RATE = 16000
T = np.arange(2 * RATE) / RATE


def path_of(x):
    return signals.pitch_path(*signals.pitch_candidates(x, RATE))


def struck(times, heights, hz=((700.0, 1.0),), fade=600.0, seconds=2.0):
    x = np.zeros(int(seconds * RATE))
    for at, a in zip(times, heights):
        n = np.arange(int(at * RATE), min(len(x), int(at * RATE) + 800))
        d = n / RATE - at
        x[n] += a * np.where(d >= 0, np.exp(-d * fade) * sum(k * np.sin(2 * np.pi * f * d) for f, k in hz), 0)
    return x


@pytest.mark.parametrize("hz", [90, 150, 310])
def test_a_weak_fundamental_keeps_its_octave(hz):
    x = sum(a * np.sin(2 * np.pi * hz * k * T + k) for k, a in ((1, 0.02), (2, 0.3), (3, 0.3), (4, 0.2)))
    path = path_of(x)
    assert abs(np.median(path[path > 0]) - hz) < 0.5 and (path > 0).mean() > 0.95


def test_a_jump_of_pitch_and_no_voice():
    phase = 2 * np.pi * np.cumsum(np.where(T < 1, 120, 235)) / RATE
    path = path_of(sum(np.sin(k * phase) / k for k in range(1, 6)) * 0.2)
    assert abs(path[20:80] - 120).max() < 1 and abs(path[120:180] - 235).max() < 1
    noise = np.random.default_rng(0).normal(0, 0.1, RATE)
    assert (path_of(noise) > 0).mean() < 0.05 and not path_of(np.zeros(RATE)).any() and not path_of(np.zeros(5)).any()


@pytest.mark.parametrize("jitter", [0.005, 0.01, 0.02])
def test_jitter_of_a_train_of_pulses(jitter):
    times = np.cumsum(1 / 120 * (1 + jitter * np.random.default_rng(1).normal(0, 1, 220)))
    x = struck(times, np.ones(len(times)))
    periods = np.diff(times)
    got, _ = signals.jitter_shimmer(x, RATE, signals.pulses(x, RATE, path_of(x)))
    want = np.abs(np.diff(periods)).mean() / periods.mean()
    assert abs(got - want) < 0.1 * want


@pytest.mark.parametrize("shimmer", [0.03, 0.1])
def test_shimmer_of_a_train_of_pulses(shimmer):
    times = np.arange(0.01, 1.95, 1 / 120)
    heights = 1 + shimmer * np.random.default_rng(2).normal(0, 1, len(times))
    x = struck(times, heights)
    jitter, got = signals.jitter_shimmer(x, RATE, signals.pulses(x, RATE, path_of(x)))
    want = np.abs(np.diff(heights)).mean() / heights.mean()
    assert abs(got - want) < 0.1 * want and jitter < 0.001


@pytest.mark.parametrize("decibels", [3, 10, 20])
def test_harmonicity_of_tone_and_noise(decibels):
    x = 0.3 * np.sin(2 * np.pi * 150 * T)
    noise = np.random.default_rng(3).normal(0, 1, len(x))
    x = x + noise * np.sqrt((x**2).mean() / 10 ** (decibels / 10) / (noise**2).mean())
    found = signals.harmonicity(x, RATE, path_of(x))
    assert abs(found[found != signals.NO_HARMONICITY].mean() - decibels) < 1


def test_two_resonances_in_noise():
    rng = np.random.default_rng(4)
    x = struck(np.arange(0.01, 1.95, 1 / 110), np.ones(220), ((700.0, 1.0), (1220.0, -700 / 1220)), 200.0)
    x = x / np.abs(x).max() * 0.5 + rng.normal(0, 1e-3, len(x))
    got = features.signal_features(x)
    assert abs(got["F1_median"] - 700) < 35 and abs(got["F2_median"] - 1220) < 61 and abs(got["pitch_median"] - 110) < 1
    assert features.formants(np.zeros(50)).shape == (0, 3) and np.isnan(features.formants(np.zeros(8000))).all()


def test_a_prediction_filter_is_found_by_the_lattice():
    rng, a = np.random.default_rng(5), np.array([1.3, -0.8])
    x = np.zeros(4000)
    for i in range(2, len(x)):
        x[i] = a @ x[i - 2 : i][::-1] + rng.normal()
    assert np.abs(signals.burg(x[None, :], 2)[0] - a).max() < 0.05


@pytest.mark.parametrize(("own", "rate"), [(44100, 16000), (48000, 16000), (16000, 44100), (22050, 16000), (8000, 16000)])
def test_rates_are_changed_in_blocks(own, rate):
    t = np.arange(own) / own
    low, high = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 0.53 * rate * t)
    whole = signals.Resampler(own, rate)
    x = np.concatenate([whole.feed(low), whole.end()])
    parts = signals.Resampler(own, rate)
    y = np.concatenate([*(parts.feed(b) for b in np.array_split(low, 37)), parts.end()])
    assert len(x) == rate and np.array_equal(x, y)
    inner = slice(1000, -1000)
    assert np.abs(x - np.sin(2 * np.pi * 1000 * np.arange(rate) / rate))[inner].max() < 1e-5
    if own > rate:
        other = signals.Resampler(own, rate)
        assert 20 * np.log10(np.abs(np.concatenate([other.feed(high), other.end()]))[inner].max()) < -60
    assert len(signals.Resampler(own, rate).end()) == 0


def test_a_filter_keeps_no_more_than_its_length():
    r = signals.Resampler(44100, 16000)
    for _ in range(20):
        r.feed(np.ones(10_000))
        assert len(r.kept) < 10_000


def naive(scores):
    frames, phones = scores.shape
    best = np.full((frames, phones), -np.inf)
    best[0, 0] = scores[0, 0]
    for t in range(1, frames):
        for p in range(phones):
            best[t, p] = max(best[t - 1, p], best[t - 1, p - 1] if p else -np.inf) + scores[t, p]
    return best[-1, -1]


def test_alignment_is_the_best_monotone_path():
    rng = np.random.default_rng(6)
    for frames, phones in ((1, 1), (5, 5), (9, 3), (60, 17), (200, 40)):
        scores = rng.normal(0, 1, (frames, phones))
        for band in (None, phones, 1000):
            begin = aligner.boundaries(scores, band)
            assert begin[0] == 0 and (np.diff(begin) > 0).all()
            of = np.searchsorted(begin, np.arange(frames), "right") - 1
            assert np.isclose(scores[np.arange(frames), of].sum(), naive(scores))
    assert aligner.boundaries(np.zeros((2, 3))) is None and aligner.boundaries(np.zeros((4, 0))) is None
    true = np.arange(0, 4000, 10)
    scores = -np.abs(np.arange(4000)[:, None] // 10 - np.arange(400)[None, :]).astype(float)
    assert np.array_equal(aligner.boundaries(scores, 8), true)


def test_rows_that_cannot_be_aligned_have_an_error(spark):
    rows = [("a", [0.0, 0.1, 1.0, 1.1], ["x", "y"]), ("b", None, ["x"]), ("c", [0.0], ["x", "y"]), ("d", [0.0], []), ("e", [1.0], ["unknown"])]
    df = spark.createDataFrame(rows, "path string, samples array<double>, phones array<string>")
    got = {r.path: r for r in aligner.aligned(df, lambda: aligner.template_scorer({"x": 0.0, "y": 1.0})).collect()}
    assert [(p.phoneme, round(p.duration, 4)) for p in got["a"].phones] == [("x", 0.02), ("y", 0.02)] and got["a"].error is None
    assert all(got[k].phones is None and got[k].error for k in "bcde")


def test_other_formats_by_a_decoder_of_ones_own(spark, tmp_path):
    (tmp_path / "x.raw").write_bytes(bytes([1, 2, 3]))
    got = readers.audio(spark, str(tmp_path), extensions=("raw",), decode=lambda content, rate: np.frombuffer(content, np.uint8) / 4.0).first()
    assert got.samples == [0.25, 0.5, 0.75]
