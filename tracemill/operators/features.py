"""Summaries of frame series, and signal features of audio in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import signals
from tracemill.functions.text import let

#: Fixed value: the sampling rate.
RATE = 16000


def summary(value: Column, prefix: str, empty: float | None = 0.0) -> list[Column]:
    """Aggregates of a series: mean, population std and variance, median, range, max, min; ``empty`` if it has no number."""
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    parts = {"mean": F.avg(v), "std": F.stddev_pop(v), "median": F.percentile(v, F.lit(0.5)), "range": F.max(v) - F.min(v), "var": F.var_pop(v), "max": F.max(v), "min": F.min(v)}
    return [(F.coalesce(c, F.lit(empty)) if empty is not None else c).alias(f"{prefix}_{n}") for n, c in parts.items()]


def good_frames(series: Column, kind: str) -> Column:
    """The frames of an array that count: pitch and formants above 0, harmonicity other than what stands for none, nothing NaN."""
    real = F.filter(series, lambda x: x.isNotNull() & ~F.isnan(x))
    if kind in ("pitch", "formant"):
        return F.filter(real, lambda x: x > 0)
    return F.filter(real, lambda x: x != signals.NO_HARMONICITY) if kind == "hnr" else real


def array_summary(series: Column) -> dict[str, Column]:
    """Mean, population std, median and range of an array within a row, 0 for an empty one."""
    n = F.size(series)
    mean = F.aggregate(series, F.lit(0.0), lambda s, x: s + x) / n
    # the mean is worked out once and not for every element
    var = let(mean, lambda m: F.aggregate(series, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / n
    middle = let(F.array_sort(series), lambda a: (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2)
    some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return {"mean": some(mean), "std": some(F.sqrt(var)), "median": some(middle), "range": some(F.array_max(series) - F.array_min(series))}


#: The highest formant in Hz, how many formants are sought, the order of prediction, the frequency from which on highs are raised.
HIGHEST_FORMANT, FORMANTS, ORDER, RAISED = 5500.0, 3, 10, 50.0


def formants(x: np.ndarray, rate: int = RATE, seconds: float = 0.05, at_once: int = 2000) -> np.ndarray:
    """(frames, FORMANTS) in Hz, NaN where a frame has fewer: the resonances of linear prediction by Burg's lattice of the signal, taken
    down to twice the highest formant and with its high frequencies raised."""
    low = int(2 * HIGHEST_FORMANT)
    if rate > low and len(x):
        down = signals.Resampler(rate, low)
        x, rate = np.concatenate([down.feed(x), down.end()]), low
    size, hop = int(rate * seconds), int(rate * signals.STEP)
    if len(x) < size:
        return np.full((0, FORMANTS), np.nan)
    x = np.append(x[:1], x[1:] - np.exp(-2 * np.pi * RAISED / rate) * x[:-1])
    bell = np.exp(-12 * ((np.arange(size) + 0.5) / size - 0.5) ** 2)
    found = []
    windows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    for k in range(0, len(windows), at_once):
        w = windows[k : k + at_once] * bell
        loud = (w**2).sum(1) > 1e-9
        out = np.full((len(w), FORMANTS), np.nan)
        out[loud] = signals.resonances(signals.burg(w[loud], ORDER), rate, HIGHEST_FORMANT, FORMANTS)
        found.append(out)
    return np.concatenate(found)


def levels(x: np.ndarray, rate: int) -> np.ndarray:
    """The level of each frame in decibels over the threshold of hearing."""
    size, hop = int(3.2 * rate / signals.PITCH[0]), int(rate * signals.STEP)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    bell = np.hanning(size)
    power = np.concatenate([((f - f.mean(1, keepdims=True)) ** 2) @ bell / bell.sum() for f in np.array_split(frames, -(-len(frames) // 4096))])
    return 10 * np.log10(power / 4e-10 + 1e-12)


def signal_features(x: np.ndarray, rate: int = RATE) -> dict[str, float]:
    """Duration, pitch along its cheapest path, level in dB, formants, harmonicity, and jitter and shimmer of single periods.

    These follow the published methods of phonetics programs, and come near to what those measure; they are not equal to it.
    """
    x = np.asarray(x, np.float64)
    out = {"duration": len(x) / rate, "sampling_frequency": float(rate)}
    path = signals.pitch_path(*signals.pitch_candidates(x, rate))
    spread = {"mean": np.mean, "std": np.std, "median": np.median, "range": np.ptp, "variance": np.var, "max": np.max, "min": np.min}
    for name, v in (("pitch", path[path > 0]), ("energy", levels(x, rate))):
        out |= {f"{name}_{k}": float(f(v)) if len(v) else 0.0 for k, f in spread.items()}
    out["energy_dynamic_range"] = out["energy_max"] - out["energy_min"]
    found = signals.harmonicity(x, rate, path)
    found = found[found != signals.NO_HARMONICITY]
    out["hnr_mean"] = float(found.mean()) if len(found) else 0.0
    for i, f in enumerate(formants(x, rate).T, 1):
        f = f[~np.isnan(f)]
        out |= {f"F{i}_{k}": float(spread[k](f)) if len(f) else 0.0 for k in ("mean", "std", "median")}
    out["jitter_local"], out["shimmer_local"] = signals.jitter_shimmer(x, rate, signals.pulses(x, rate, path))
    return out


#: An extractor takes samples and their rate and gives numbers by name.
Extractor = Callable[[np.ndarray, int], dict[str, float]]


def extract(audio: DataFrame, key: str = "path", samples: str = "samples", rate: int = RATE, make_extractor: Callable[[], Extractor] = lambda: signal_features) -> DataFrame:
    """(key, values, error): the features of each row's samples as a map; rows without samples, and those on which the extractor
    fails, have an error instead. ``make_extractor`` makes it once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make_extractor()
        for b in batches:
            values, errors = [], []
            for x in b[samples]:
                found, error = None, None
                if x is None or len(x) == 0:
                    error = "no samples"
                else:
                    try:
                        found = extractor(np.asarray(x, np.float64), rate)
                    except (ArithmeticError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                values.append(found)
                errors.append(error)
            yield pd.DataFrame({key: b[key], "values": values, "error": errors})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, samples).mapInPandas(run, f"`{key}` {kind}, values map<string,double>, error string")
