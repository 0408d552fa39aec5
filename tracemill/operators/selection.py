"""Generated candidates: exploding, choosing one for each item, final status, the training view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import ensure_closing_tag


def explode_candidates(rows: DataFrame, texts: str = "texts") -> DataFrame:
    """One row for each candidate: the other columns, k (from 0), text."""
    rest = [c for c in rows.columns if c != texts]
    return rows.select(*rest, F.posexplode(texts).alias("k", "text")).withColumn("text", ensure_closing_tag(F.col("text")))


def first_passing(candidates: DataFrame, keys: Sequence[str], hard: Column, soft: Column | None = None, order: str = "k", policy: str = "first") -> DataFrame:
    """One row for each item: the chosen candidate's columns as struct ``chosen``, null if none passes ``hard``, and the first
    candidate of all as ``fallback``.

    "first": of those that pass ``hard`` the first decides, whatever ``soft`` says of it and of later ones. "best": the first
    that passes both, else the first that passes ``hard``.
    """
    if policy not in ("first", "best"):
        raise ValueError(f"unknown policy {policy}")
    rest = F.struct(*[c for c in candidates.columns if c not in keys])
    rank = F.struct(order) if policy == "first" or soft is None else F.struct(F.when(soft, 0).otherwise(1).alias("miss"), F.col(order))
    return candidates.groupBy(*keys).agg(F.min_by(F.when(hard, rest), F.when(hard, rank)).alias("chosen"), F.min_by(rest, F.col(order)).alias("fallback"))


def finalise(selected: DataFrame, text: str = "text", passed: str = "soft_passed", reason: str = "soft_reason", broken: str = "violations") -> DataFrame:
    """generated_reasoning, validation_status (pass or fail) and fail_reason of what first_passing() chose; without a choice the
    fallback's text and its violations."""
    c, f = F.col("chosen"), F.col("fallback")
    hard = F.concat(F.lit("Hard Fail: ["), F.array_join(F.transform(f[broken], lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))
    ok = c.isNotNull() & F.coalesce(c[passed], F.lit(False))
    out = {
        "generated_reasoning": F.when(c.isNotNull(), c[text]).otherwise(f[text]),
        "validation_status": F.when(ok, "pass").otherwise("fail"),
        "fail_reason": F.when(ok, F.lit(None)).when(c.isNotNull(), c[reason]).otherwise(hard),
    }
    return selected.withColumns(out).drop("chosen", "fallback")


def to_training_view(final: DataFrame, strip_tags: bool = False) -> DataFrame:
    """(audio_path, prompt, response, answer) of items that passed; with ``strip_tags`` only what the response block holds."""
    response = F.col("generated_reasoning")
    if strip_tags:
        response = F.regexp_replace(response, r"(?is)^.*<RESPONSE>\s*|\s*</RESPONSE>.*$", "")
    return final.filter(F.col("validation_status") == "pass").select("audio_path", "prompt", response.alias("response"), F.col("ground_truth_answer").alias("answer"))
