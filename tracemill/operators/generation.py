"""Models as plug-ins: a factory makes the model once for each task, and batches of prompts go through it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model takes prompts and gives for each as many texts as it was asked for.
Model = Callable[[Sequence[str], int], list[list[str]]]


def generate(items: DataFrame, make_model: Callable[[], Model], prompt: str = "model_prompt", n: int = 3, batch: int = 200) -> DataFrame:
    """``items`` with ``texts``: ``n`` candidates for each prompt, in batches of ``batch``; a null prompt counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch].copy()
                part["texts"] = model([p or "" for p in part[prompt]], n)
                yield part

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in items.schema.fields)
    return items.mapInPandas(run, f"{fields}, texts array<string>")


def chunks(samples: Column, rate: int = 16000, seconds: float = 30.0) -> Column:
    """Samples as an array of pieces of ``seconds``, the last one shorter; none for no samples."""
    size = int(rate * seconds)
    starts = F.when(F.size(samples) > 0, F.sequence(F.lit(1), F.size(samples), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda a: F.slice(samples, a, size))


def transcribed(audio: DataFrame, make_model: Callable[[], Callable[[Sequence[Sequence[float]]], list[str]]], key: str = "path", samples: str = "samples", rate: int = 16000, seconds: float = 30.0, batch: int = 16) -> DataFrame:
    """(key, text): what a recogniser hears, in pieces of ``seconds`` and batches of ``batch``, the pieces joined by blanks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for f in frames:
            flat = [piece for pieces in f["pieces"] for piece in pieces]
            heard = iter([text for k in range(0, len(flat), batch) for text in model(flat[k : k + batch])])
            yield pd.DataFrame({key: f[key], "text": [" ".join(t for t in (next(heard).strip() for _ in pieces) if t) for pieces in f["pieces"]]})

    rows = audio.select(key, chunks(F.coalesce(samples, F.array().cast("array<double>")), rate, seconds).alias("pieces"))
    return rows.mapInPandas(run, f"`{key}` {audio.schema[key].dataType.simpleString()}, text string")


def transcriber(make_model: Callable[[], Callable[[Sequence[bytes]], list[str]]]) -> Callable[[Column], Column]:
    """A function from a column of audio to a column of what a recogniser hears in it."""

    @F.pandas_udf("string")
    def hear(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for s in parts:
            yield pd.Series(model(list(s)))

    return hear


def stub_model(traits: Sequence[str] = ("f0_level=low", "speaking_rate=fast", "vowel_ratio=mid"), labels: Sequence[str] = ("male", "female")) -> Model:
    """A model without weights, for tests: well-formed traces whose traits and label are hashed from the prompt."""

    def one(prompt: str, k: int) -> str:
        h = int(hashlib.md5(f"{prompt}:{k}".encode()).hexdigest(), 16)
        a, b = traits[h % len(traits)], traits[(h // 7) % len(traits)]
        return f"<THINK>{a} and {b} matter.</THINK>\n<RESPONSE>Based on features such as {a}, {b}, the speaker is most consistent with: {labels[(h // 91) % len(labels)]}.</RESPONSE>"

    return lambda prompts, n: [[one(p, k) for k in range(n)] for p in prompts]
