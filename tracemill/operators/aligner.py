"""Forced alignment: when each phone of a known sequence is spoken, by the best monotone path through frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A scorer takes samples and phones and gives the log likelihood of each phone in each frame, (frames, phones).
Scorer = Callable[[np.ndarray, Sequence[str]], np.ndarray]


def boundaries(scores: np.ndarray, band: int | None = None) -> np.ndarray | None:
    """The frame at which each phone begins, on the path with the greatest sum on which each phone has a frame or more, in order; None with
    fewer frames than phones.

    ``band`` bounds how many phones the path may be off the straight line from begin to end, and so the memory: one bit for
    each frame and phone of the band.
    """
    frames, phones = scores.shape
    if not 0 < phones <= frames:
        return None
    width = phones if band is None else min(phones, 2 * band + 1)
    first = np.clip(np.round(np.arange(frames) * (phones - 1) / max(1, frames - 1)).astype(np.int64) - width // 2, 0, phones - width)
    total = np.full(width, -np.inf)
    total[0] = scores[0, 0]
    entered = np.zeros((frames, width), bool)
    for t in range(1, frames):
        # the row before, as seen from this row's first phone
        move = first[t] - first[t - 1]
        stay = np.full(width, -np.inf)
        stay[: width - move] = total[move:]
        enter = np.full(width, -np.inf)
        enter[1:] = stay[:-1]
        if move:
            enter[0] = total[move - 1]
        entered[t] = enter > stay
        total = np.maximum(stay, enter) + scores[t, first[t] : first[t] + width]
    if not np.isfinite(total[phones - 1 - first[-1]]):
        return None
    begin, phone = np.zeros(phones, np.int64), phones - 1
    for t in range(frames - 1, 0, -1):
        if entered[t, phone - first[t]]:
            begin[phone] = t
            phone -= 1
    return begin


def aligned(audio: DataFrame, make_scorer: Callable[[], Scorer], key: str = "path", samples: str = "samples", phones: str = "phones", step: float = 0.01, band: int | None = None) -> DataFrame:
    """(key, phones, error): each phone with its duration in seconds, as the parser of finished alignments gives them; ``step`` is the
    scorer's distance of frames. A row without samples or phones, one with fewer frames than phones, and one on which the scorer fails
    have an error instead. ``make_scorer`` makes it once for each task."""

    def one(scorer: Scorer, x, names):
        if x is None or names is None or not len(x) or not len(names):
            return None, "no samples or no phones"
        try:
            scores = np.asarray(scorer(np.asarray(x, np.float64), list(names)), np.float64)
        except (ArithmeticError, ValueError, KeyError) as e:
            return None, f"{type(e).__name__}: {e}"
        begin = boundaries(scores, band)
        if begin is None:
            return None, "fewer frames than phones, or a path outside the band"
        sizes = np.diff(np.append(begin, len(scores)))
        return [{"phoneme": n, "duration": float(d)} for n, d in zip(names, sizes * step)], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for f in frames:
            found = [one(scorer, x, names) for x, names in zip(f[samples], f[phones])]
            yield pd.DataFrame({key: f[key], "phones": [p for p, _ in found], "error": [e for _, e in found]})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, samples, phones).mapInPandas(run, f"`{key}` {kind}, phones array<struct<phoneme:string,duration:double>>, error string")


def template_scorer(levels: dict[str, float], frame: int = 1) -> Scorer:
    """A scorer without a model, for tests: a phone is likely where the mean of a frame's samples is near its level."""

    def score(x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        means = x[: len(x) // frame * frame].reshape(-1, frame).mean(1)
        return -((means[:, None] - np.array([levels[n] for n in names])[None, :]) ** 2)

    return score
