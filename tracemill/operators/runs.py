"""Whole runs, composed of the other operators: from entries to items with traits, and from these to judged traces."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import phonology, text, validation
from tracemill.operators import corpus, generation, items, latents, selection
from tracemill.operators.features import Extractor, extract, signal_features
from tracemill.operators.held import held
from tracemill.sources.writers import write_observed

#: What a template may name.
TEMPLATE = "Question: {question}\nCandidates: {candidates}\nTraits: {latent}\nAnswer: {answer}\nTranscript: {transcript}"
JUDGE_TEMPLATE = "{question}\n{candidates}\n{latent}\n{trace}"


def items_with_traits(entries: DataFrame, features: DataFrame, phones: DataFrame, attributes: Mapping[str, str] = items.PROMPTS, limit: int = 0, done: DataFrame | None = None, dedupe_audio: bool = False) -> DataFrame:
    """(audio_path, prompt, transcript, ground_truth_answer, latent_json) of entries (audio_path, transcript, speaker).

    ``features`` (audio_path, values) and ``phones`` (audio_path, phones) are attached once for each recording; a recording
    without them has scalars of 0. Quantiles are fitted over items, so that a recording counts once for each of its
    attributes, or with ``dedupe_audio`` once. Items of ``done`` are left out after the fit.
    """
    n_items = sum((F.when(F.col("speaker")[a].isNotNull(), 1).otherwise(0) for a in attributes), F.lit(0))
    chosen = items.limit_entries(entries, n_items, limit, ["audio_path"])
    weight = chosen.groupBy("audio_path").agg(F.sum(n_items).alias("_weight"))
    audio = corpus.attach(weight, features, "audio_path", "values", F.create_map().cast("map<string,double>"))
    audio = corpus.attach(audio, phones, "audio_path", "phones", F.array().cast("array<struct<phoneme:string,duration:double>>"))
    scalars = audio.select("audio_path", "_weight", *[c.alias(n) for n, c in phonology.scalars(F.col("values"), F.col("phones")).items()]).filter("_weight > 0")
    scalars = held(scalars, "scalars")  # read by the estimate, the fit and the join
    stats = latents.fit_row(scalars, [s for s in phonology.SCALARS if s != "has_syllabic"], weight=None if dedupe_audio else "_weight")
    found = items.unpivot_attributes(chosen, attributes, ["audio_path", "transcript"], speaker="speaker").withColumnRenamed("answer", "ground_truth_answer")
    if done is not None:
        found = items.not_done(found, done, ["audio_path", "prompt"])
    return found.join(latents.traits(scalars, stats), "audio_path").select("audio_path", "prompt", "transcript", "ground_truth_answer", "latent_json")


def judged_traces(found: DataFrame, make_model: Callable[[], generation.Model], make_judge: Callable[[], generation.Model], template: str = TEMPLATE, judge_template: str = JUDGE_TEMPLATE, n: int = 3, policy: str = "first") -> DataFrame:
    """``found`` with generated_reasoning, validation_status and fail_reason: ``n`` candidates an item, the rules, and a judge
    for the candidates that pass them. Items with a blocked answer are left out; repeated items are judged each by itself.

    What a model says is written to the shared folder once, since it need not say the same again.
    """
    kept = items.drop_blocked(found, "ground_truth_answer").withColumn("candidates", items.candidates_for(F.col("prompt")))
    latent_type = found.schema["latent_json"].dataType
    values = {"{question}": F.col("prompt"), "{candidates}": text.choices(F.col("candidates")), "{latent}": F.to_json("latent_json"), "{answer}": F.col("ground_truth_answer"), "{transcript}": F.col("transcript")}
    asked = kept.select("audio_path", "prompt", "transcript", "ground_truth_answer", "candidates", F.to_json("latent_json").alias("latent"), validation.valid_pairs(F.col("latent_json"), phonology.GROUPS).alias("pairs"), F.monotonically_increasing_id().alias("_item"), text.fill_template(template, values).alias("model_prompt"))
    made = selection.explode_candidates(generation.generate(asked, make_model, n=n)).drop("model_prompt")
    checked = held(made.withColumn("violations", validation.violations(F.col("text"), F.col("pairs"), F.col("candidates"))), "candidates")
    good = checked.filter(F.size("violations") == 0)
    said = {"{question}": F.col("prompt"), "{candidates}": text.choices(F.col("candidates")), "{latent}": F.col("latent"), "{trace}": F.col("text")}
    replies = generation.generate(good.select("_item", "k", text.fill_template(judge_template, said).alias("judge_prompt")), make_judge, prompt="judge_prompt", n=1)
    verdicts = replies.select("_item", "k", validation.soft_verdict(F.col("texts")[0]).alias("v")).select("_item", "k", F.col("v.passed").alias("soft_passed"), F.col("v.reason").alias("soft_reason"))
    both = checked.join(held(verdicts, "verdicts"), ["_item", "k"], "left")
    keys = ["_item", "audio_path", "prompt", "transcript", "ground_truth_answer", "latent"]
    chosen = selection.first_passing(both.drop("candidates", "pairs"), keys, F.size("violations") == 0, F.col("soft_passed"), policy=policy)
    return selection.finalise(chosen).withColumn("latent_json", F.from_json("latent", latent_type)).drop("_item", "latent")


def feature_run(audio: DataFrame, folder: str, meta: Sequence[str], make_extractor: Callable[[], Extractor] = lambda: signal_features, key: str = "path", samples: str = "samples") -> tuple[DataFrame, DataFrame, DataFrame, dict[str, object]]:
    """(features, metadata, failures, counts) of one pass over the recordings.

    One table is written, with the metadata, the features and the error of each recording; the three frames are parts of it, and the
    counts (n, failed, and the seconds of audio) were taken while it was written. Features are (key, values), metadata is the columns
    ``meta`` of the recordings that have features, failures are (key, error).
    """
    described = audio.select(key, samples, F.struct(*meta).alias("meta"))
    found = extract(described.withColumn("_key", F.struct(key, "meta")), "_key", samples, make_extractor=make_extractor)
    rows = found.select(F.col(f"_key.{key}").alias(key), F.col("_key.meta").alias("meta"), "values", "error")
    counts = write_observed(rows, folder, n=F.count("*"), failed=F.count_if(F.col("error").isNotNull()), seconds=F.coalesce(F.sum(F.col("values")["duration"]), F.lit(0.0)))
    whole = audio.sparkSession.read.schema(rows.schema).parquet(folder)
    good = whole.filter("error IS NULL")
    return good.select(key, "values"), good.select(*[F.col(f"meta.{c}").alias(c) for c in meta]), whole.filter("error IS NOT NULL").select(key, "error"), counts
