"""Measures of a voice in numpy: pitch by a cheapest path, single periods, harmonicity, formants by Burg's lattice, and resampling."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np

#: The range of pitch in Hz, the step of frames in seconds, what stands for no harmonicity; the costs of a pitch path: of
#: silence and of no voice, of each octave down, of a jump by an octave, of going from voice to none.
PITCH = (75.0, 600.0)
STEP = 0.01
NO_HARMONICITY = -200.0
SILENCE, VOICING, OCTAVE, JUMP, TURN = 0.03, 0.45, 0.01, 0.35, 0.14
#: Fixed values of jitter and shimmer: the shortest and longest period in seconds, how many times a period or an amplitude may be its neighbour.
PERIODS, PERIOD_FACTOR, AMPLITUDE_FACTOR = (0.0001, 0.02), 1.3, 1.6
CANDIDATES = 8


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def pitch_candidates(x: np.ndarray, rate: int, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(pitch, strength) of the candidates of each frame, the first one for no voice (pitch 0): peaks of the autocorrelation of a windowed
    frame over that of the window, cut in half at the shortest lags so that a weak fundamental still has its peak."""
    size, hop = int(3 * rate / PITCH[0]), int(rate * STEP)
    low, high = int(rate / PITCH[1]), int(rate / PITCH[0])
    n = 1 << (2 * size - 1).bit_length()
    window = np.hanning(size)
    own = np.fft.irfft(np.abs(np.fft.rfft(window, n)) ** 2)[: high + 2]
    every = _frames(x, size, hop)
    loudest = max(float(np.abs(x - x.mean()).max()) if len(x) else 0.0, 1e-12)
    found = []
    for k in range(0, len(every), at_once):
        f = every[k : k + at_once]
        f = f - f.mean(1, keepdims=True)
        local = np.abs(f).max(1)
        auto = np.fft.irfft(np.abs(np.fft.rfft(f * window, n, axis=1)) ** 2, axis=1)[:, : high + 2]
        auto = auto / np.maximum(auto[:, :1], 1e-20) / (own / own[0])
        inner = auto[:, low : high + 1]
        peak = (inner > auto[:, low - 1 : high]) & (inner >= auto[:, low + 1 : high + 2]) & (inner > 0.5 * VOICING)
        lag = np.arange(low, high + 1)
        value = np.where(peak, inner - OCTAVE * np.log2(PITCH[0] * lag / rate), -np.inf)
        best = np.argsort(-value, axis=1)[:, :CANDIDATES]
        at = best + low
        rows = np.arange(len(f))[:, None]
        before, here, after = auto[rows, at - 1], auto[rows, at], auto[rows, at + 1]
        bend = before - 2 * here + after
        shift = np.clip(np.divide(0.5 * (before - after), bend, out=np.zeros_like(bend), where=bend < 0), -0.5, 0.5)
        real = np.isfinite(np.take_along_axis(value, best, 1))
        height = np.minimum(here - 0.25 * (before - after) * shift, 1.0)
        strength = np.where(real, height - OCTAVE * np.log2(PITCH[0] * (at + shift) / rate), -np.inf)
        none = VOICING + np.maximum(0.0, 2 - (local / loudest) * (1 + VOICING) / SILENCE)
        found.append((np.concatenate([np.zeros((len(f), 1)), np.where(real, rate / (at + shift), 0.0)], 1), np.concatenate([none[:, None], strength], 1)))
    return tuple(np.concatenate(p) for p in zip(*found))


def pitch_path(pitch: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """The pitch of each frame, 0 for no voice, on the path through the candidates with the greatest strength less its jumps and turns."""
    log = np.log2(np.maximum(pitch, 1e-9))
    voiced = pitch > 0
    total = strength[0]
    back = np.zeros(pitch.shape, np.int64)
    for t in range(1, len(pitch)):
        both, one = voiced[t - 1][:, None] & voiced[t][None, :], voiced[t - 1][:, None] != voiced[t][None, :]
        step = total[:, None] - np.where(both, JUMP * np.abs(log[t - 1][:, None] - log[t][None, :]), 0.0) - TURN * one
        back[t] = step.argmax(0)
        total = step.max(0) + strength[t]
    out, k = np.zeros(len(pitch)), int(total.argmax())
    for t in range(len(pitch) - 1, -1, -1):
        out[t] = pitch[t, k]
        k = back[t, k]
    return out


def _next_period(x: np.ndarray, at: float, period: float, way: int) -> float | None:
    """Where the stretch of one period around ``at`` comes again, a period before (-1) or behind (1) it: the best cross-correlation, between samples."""
    half = max(2, int(period / 2))
    here = int(round(at))
    shifts = np.arange(int(0.8 * period), int(1.25 * period) + 2)
    first, last = here - half + (-(shifts[-1] + 1) if way < 0 else 0), here + half + (shifts[-1] + 1 if way > 0 else 0)
    if first < 0 or last > len(x):
        return None
    own = x[here - half : here + half]
    every = np.lib.stride_tricks.sliding_window_view(x, len(own))[here - half + way * shifts]
    score = every @ own / np.sqrt(np.maximum((every**2).sum(1) * (own @ own), 1e-20))
    k = int(score.argmax())
    if score[k] < 0.3:
        return None
    shift = float(shifts[k])
    if 0 < k < len(score) - 1:
        bend = score[k - 1] - 2 * score[k] + score[k + 1]
        shift += 0.5 * (score[k - 1] - score[k + 1]) / bend if bend < 0 else 0.0
    # the stretch was cut at a whole sample
    return at + way * shift


def pulses(x: np.ndarray, rate: int, path: np.ndarray) -> list[np.ndarray]:
    """For each voiced stretch the places, in samples, where its periods begin: from its greatest peak on to both sides."""
    hop, offset = int(rate * STEP), int(1.5 * rate / PITCH[0])
    voiced = np.concatenate([[0], (path > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(voiced))
    out = []
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
        first, last = a * hop + offset - hop // 2, min(len(x), (b - 1) * hop + offset + hop // 2)
        if last - first < 2:
            continue
        middle = (first + last) // 2
        near = int(rate / path[(a + b) // 2])
        start = max(first, middle - near)
        peak = start + int(np.abs(x[start : middle + near]).argmax())
        found = [float(peak)]
        for way in (-1, 1):
            at = float(peak)
            while first <= at < last:
                frame = min(max(int((at - offset) / hop + 0.5), a), b - 1)
                at = _next_period(x, at, rate / path[frame], way)
                if at is None or not first <= at < last:
                    break
                found.append(at)
        out.append(np.sort(np.array(found)))
    return out


def jitter_shimmer(x: np.ndarray, rate: int, places: list[np.ndarray]) -> tuple[float, float]:
    """The mean change from a period to the next one over the mean period, and the same of amplitudes; 0 without two periods."""
    periods, steps, heights, changes = [], [], [], []
    for p in places:
        t = np.diff(p) / rate
        good = (t >= PERIODS[0]) & (t <= PERIODS[1])
        pair = good[:-1] & good[1:] & (np.maximum(t[:-1], t[1:]) <= PERIOD_FACTOR * np.minimum(t[:-1], t[1:]))
        periods.append(t[good])
        steps.append(np.abs(np.diff(t))[pair])
        edges = np.round((p[:-1] + p[1:]) / 2).astype(np.int64)
        high = np.array([np.abs(x[a:b]).max() if b > a else 0.0 for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])
        ok = (high[:-1] > 0) & (high[1:] > 0) & (np.maximum(high[:-1], high[1:]) <= AMPLITUDE_FACTOR * np.minimum(high[:-1], high[1:]))
        heights.append(high)
        changes.append(np.abs(np.diff(high))[ok])
    share = lambda change, of: float(np.concatenate(change).mean() / np.concatenate(of).mean()) if sum(map(len, change)) and sum(map(len, of)) else 0.0
    return share(steps, periods), share(changes, heights)


def harmonicity(x: np.ndarray, rate: int, path: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Decibels of what repeats over what doesn't, for each frame of the path: the normalized cross-correlation of neighbouring stretches at
    the lag of the pitch; NO_HARMONICITY where there is no voice."""
    hop, size, high = int(rate * STEP), int(rate / PITCH[0]), int(1.1 * rate / PITCH[0]) + 2
    out = np.full(len(path), NO_HARMONICITY)
    n = 1 << (2 * size + high).bit_length()
    padded = np.pad(x, (0, 2 * size + high + hop))
    every = np.lib.stride_tricks.sliding_window_view(padded, size + high)
    voiced = np.flatnonzero((path > 0) & (np.arange(len(path)) * hop < len(every)))
    for k in range(0, len(voiced), at_once):
        some = voiced[k : k + at_once]
        f = every[some * hop]
        f = f - f.mean(1, keepdims=True)
        a = f[:, :size]
        cross = np.fft.irfft(np.conj(np.fft.rfft(a, n, axis=1)) * np.fft.rfft(f, n, axis=1), axis=1)[:, : high + 1]
        square = np.pad(np.cumsum(f**2, axis=1), ((0, 0), (1, 0)))
        energy = square[:, size : size + high + 1] - square[:, : high + 1]
        r = cross / np.sqrt(np.maximum(energy * energy[:, :1], 1e-20))
        lag = rate / path[some]
        near = np.abs(np.arange(high + 1)[None, :] - lag[:, None]) <= np.maximum(1.0, 0.1 * lag[:, None])
        at = np.clip(np.where(near, r, -np.inf).argmax(1), 1, high - 1)
        rows = np.arange(len(some))
        before, here, after = r[rows, at - 1], r[rows, at], r[rows, at + 1]
        bend = before - 2 * here + after
        shift = np.clip(np.divide(0.5 * (before - after), bend, out=np.zeros_like(bend), where=bend < 0), -0.5, 0.5)
        best = np.clip(here - 0.25 * (before - after) * shift, 1e-6, 1 - 1e-6)
        out[some] = 10 * np.log10(best / (1 - best))
    return out


def burg(frames: np.ndarray, order: int) -> np.ndarray:
    """(frames, order): linear prediction coefficients by Burg's lattice: each stage's reflection makes the errors forwards and backwards
    together least."""
    forward, backward = frames[:, 1:].copy(), frames[:, :-1].copy()
    a = np.zeros((len(frames), order))
    for m in range(order):
        k = 2 * (forward * backward).sum(1) / np.maximum((forward**2).sum(1) + (backward**2).sum(1), 1e-20)
        old = a[:, :m].copy()
        a[:, :m] = old - k[:, None] * old[:, ::-1]
        a[:, m] = k
        forward, backward = (forward - k[:, None] * backward)[:, 1:], (backward - k[:, None] * forward)[:, :-1]
    return a


def resonances(a: np.ndarray, rate: float, highest: float, count: int) -> np.ndarray:
    """(frames, count) in Hz, NaN where a frame has fewer: the angles of the roots of prediction coefficients."""
    order = a.shape[1]
    companion = np.zeros((len(a), order, order))
    companion[:, 0], companion[:, np.arange(1, order), np.arange(order - 1)] = a, 1.0
    roots = np.linalg.eigvals(companion)
    freq, width = np.angle(roots) * rate / (2 * np.pi), -np.log(np.maximum(np.abs(roots), 1e-12)) * rate / np.pi
    return np.sort(np.where((freq > 50) & (freq < highest - 50) & (width < 700), freq, np.nan), axis=1)[:, :count]


def _reflected(x: np.ndarray, before: int, behind: int) -> np.ndarray:
    return np.pad(x, (before, behind), "reflect", reflect_type="odd") if len(x) > 1 else np.pad(x, (before, behind), "edge")


class Resampler:
    """Takes samples at one rate in blocks of any size and gives them at another: a windowed sinc, of which only the phases that
    occur are made; of past blocks it keeps as much as the filter is long. Before its begin and behind its end a signal goes on as
    its own reflection in the first or last sample."""

    def __init__(self, own: int, rate: int, crossings: int = 48, beta: float = 9.0):
        d = gcd(own, rate)
        self.up, self.down = rate // d, own // d
        # the pass band ends a little below half the lower rate
        cut = min(1.0, rate / own) * (1 - 2.0 / crossings)
        self.half = int(np.ceil(crossings / min(1.0, rate / own)))
        at = np.arange(-self.half + 1, self.half + 1)[None, :] - np.arange(self.up)[:, None] / self.up
        self.bank = cut * np.sinc(cut * at) * np.i0(beta * np.sqrt(np.maximum(0.0, 1 - (at / self.half) ** 2))) / np.i0(beta)
        self.bank /= self.bank.sum(1, keepdims=True)
        self.kept, self.begin, self.given, self.taken, self.begun = np.zeros(0), -(self.half - 1), 0, 0, False

    def _ready(self, n: int, at_once: int = 1 << 14) -> Iterator[np.ndarray]:
        """Output samples up to number ``n``."""
        for k in range(self.given, n, at_once):
            out = np.arange(k, min(n, k + at_once), dtype=np.int64)
            at, phase = np.divmod(out * self.down, self.up)
            rows = np.lib.stride_tricks.sliding_window_view(self.kept, 2 * self.half)[at - self.half + 1 - self.begin]
            yield (rows * self.bank[phase]).sum(1)
        self.given = max(self.given, n)
        keep = min(self.given * self.down // self.up - self.half + 1 - self.begin, len(self.kept))
        if keep > 0:
            self.kept, self.begin = self.kept[keep:], self.begin + keep

    def feed(self, x: np.ndarray) -> np.ndarray:
        self.kept = np.concatenate([self.kept, x])
        self.taken += len(x)
        if not self.begun and len(self.kept) < self.half:
            return np.zeros(0)
        self._begin()
        # the last input sample that a filter's end may stand on
        n = max(self.given, ((self.taken - self.half) * self.up - 1) // self.down + 1)
        return np.concatenate([np.zeros(0), *self._ready(n)])

    def _begin(self) -> None:
        if not self.begun:
            self.kept, self.begun = _reflected(self.kept, self.half - 1, 0), True

    def end(self) -> np.ndarray:
        if not self.taken:
            return np.zeros(0)
        self._begin()
        self.kept = _reflected(self.kept, 0, 2 * self.half)
        return np.concatenate([np.zeros(0), *self._ready(int(self.taken * self.up // self.down))])
