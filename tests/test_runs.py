"""Whole runs on a few entries, and quantiles by rank."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tracemill.operators import intervals, latents, quantiles, runs, selection
from tracemill.sources import readers, writers
from tracemill.sources.readers import SPEAKER


def entries(spark):
    speaker = lambda **x: tuple(x.get(k) for k in ("age", "comments", "dialect_region", "education", "ethnicity", "gender", "height", "id", "nationality", "native_language", "race", "weight"))
    rows = [("a.wav", "hello", speaker(gender="male", age="46-55")), ("b.wav", "", speaker(gender="female")), ("c.wav", None, None), ("d.wav", "x", speaker(gender="unknown"))]
    return spark.createDataFrame(rows, f"audio_path string, transcript string, speaker {SPEAKER}")


def side(spark):
    features = spark.createDataFrame([("a.wav", {"pitch_mean": 100.0}), ("b.wav", {"pitch_mean": 200.0})], "audio_path string, values map<string,double>")
    phones = spark.createDataFrame([("a.wav", [("a", 0.1), ("t", 0.1)])], "audio_path string, phones array<struct<phoneme:string,duration:double>>")
    return features, phones


def test_items_carry_the_traits_of_their_recording(spark):
    found = runs.items_with_traits(entries(spark), *side(spark))
    got = {(r.audio_path, r.ground_truth_answer): r.latent_json.acoustic.f0_level for r in found.collect()}
    # values 100, 100, 200, 0 by item: q33 = 99, q66 = 100
    assert got == {("a.wav", "male"): "mid", ("a.wav", "46-55"): "mid", ("b.wav", "female"): "high", ("d.wav", "unknown"): "low"}
    done = found.filter("audio_path = 'a.wav'").select("audio_path", "prompt")
    assert runs.items_with_traits(entries(spark), *side(spark), done=done).count() == 2


def test_traces_are_generated_checked_and_judged(spark):
    found = runs.items_with_traits(entries(spark), *side(spark))

    def model():
        def say(prompts, n):
            good = "<THINK>x</THINK><RESPONSE>Based on features such as f0_level={}, f0_var=low, the speaker is most consistent with: {}."
            out = []
            for p in prompts:
                level = "high" if '"f0_level":"high"' in p else "mid"
                out.append(["no blocks", good.format(level, "male"), good.format(level, "female")] if "46-55" not in p else ["no blocks"] * n)
            return out

        return say

    judge = lambda: lambda prompts, n: [['{"checks": {"a": true}}' if "female." in p else '{"checks": {"a": false}}'] for p in prompts]
    first = {(r.audio_path, r.ground_truth_answer): r for r in runs.judged_traces(found, model, judge).collect()}
    assert set(first) == {("a.wav", "male"), ("a.wav", "46-55"), ("b.wav", "female")}
    assert first["a.wav", "male"].validation_status == "fail" and first["a.wav", "male"].fail_reason == "Soft checks failed"
    assert first["a.wav", "46-55"].fail_reason.startswith("Hard Fail: ['Format Error")
    best = runs.judged_traces(found, model, judge, policy="best")
    rows = {r.ground_truth_answer: r for r in best.collect()}
    assert rows["male"].validation_status == "pass" and rows["male"].generated_reasoning.endswith("female.\n</RESPONSE>")
    assert rows["male"].latent_json.acoustic.f0_level == "mid"
    view = selection.to_training_view(best, strip_tags=True)
    assert view.columns == ["audio_path", "prompt", "response", "answer"] and view.count() == 2


def test_exact_quantiles_of_sketches_and_ranks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice((rng.random(), 0.5, float("nan"))), None if i % 7 else float(rng.randrange(9)), None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "x double, y double, z double").selectExpr("*", "int(coalesce(y, 2)) AS w").cache()
    values = {s: np.array([r[i] for r in rows if r[i] is not None and r[i] == r[i]]) for i, s in enumerate("xy")}
    fits = [latents.fit(df, ["x", "y", "z"]), latents.fit_by_rank(df, ["x", "y", "z"])]
    # a sketch of few bytes, brackets that are too narrow at first, and ranks by ranges give the same
    monkeypatch.setattr(quantiles, "SKETCH", 64)
    monkeypatch.setattr(quantiles, "BY_WINDOW", 0)
    found = latents.sketches(df, ["x", "y", "z"])
    each = quantiles.exact(latents.long_form(df, ["x", "y", "z"]), found, [0.33, 0.66], error=1e-9)
    fits.append(latents._both(found, each))
    for fit in fits:
        got = {r.scalar: r for r in fit.collect()}
        for s, v in values.items():
            assert np.allclose([got[s].q33, got[s].q66, got[s]["min"], got[s]["max"]], [*np.percentile(v, (33, 66)), v.min(), v.max()])
        assert tuple(got["z"]) == ("z", 0.0, 0.0, None, None)
    near, far = latents.fit_row(df, ["x", "y"], "w").first(), latents._both(*[f(df, ["x", "y"]) for f in (lambda d, s: latents.sketches(d, s, "w"), lambda d, s: quantiles.exact(latents.long_form(d, s, "w"), latents.sketches(d, s, "w"), [0.33, 0.66], weight="w"))])
    copies = {s: np.repeat(*zip(*[(r[i], 2 if r[1] is None else int(r[1])) for r in rows if r[i] is not None and r[i] == r[i]])) for i, s in enumerate("xy")}
    for r in far.collect():
        assert np.allclose([r.q33, r.q66], np.percentile(copies[r.scalar], (33, 66))) and np.allclose([r.q33, r.q66], [near[f"{r.scalar}_q33"], near[f"{r.scalar}_q66"]])
    none = df.filter(F.lit(False))
    assert [tuple(r) for r in latents.fit(none, ["x"]).collect()] == [("x", 0.0, 0.0, None, None)] and tuple(latents.fit_row(none, ["x"]).first()) == (0.0, 0.0)
    one = spark.createDataFrame([(5.0,)], "x double")
    assert tuple(latents.fit_by_rank(one, ["x"]).first()) == ("x", 5.0, 5.0, 5.0, 5.0)
    assert latents.fit_by_rank(one.filter(F.lit(False)), ["x"]).collect() == []


def test_sketches_of_several_runs(spark, tmp_path):
    runs = [spark.range(a, b).select(F.col("id").cast("double").alias("x")) for a, b in ((0, 9000), (9000, 30_000))]
    for k, run in enumerate(runs):
        writers.write_sketches(latents.sketches(run, ["x"]), str(tmp_path / str(k)))
    found = quantiles.merged([readers.sketches(spark, str(tmp_path / str(k))) for k in range(2)])
    r = found.first()
    assert (r.n, r["min"], r["max"]) == (30_000, 0.0, 29_999.0)
    both = runs[0].unionByName(runs[1])
    assert np.allclose(list(latents.fit_row(both, ["x"], found=found).first()), np.percentile(np.arange(30_000), (33, 66)))
    assert all(abs(r.value / 30_000 - r.q) < 0.01 for r in quantiles.estimated(found, [0.1, 0.5, 0.9]).collect())


def test_ranges_of_one_long_file_give_what_one_task_gives(spark):
    rng = random.Random(8)
    rows = [(f, i, i * 10.0 + (3 if rng.random() < 0.05 else 0), rng.choice(["a", "a", "a", "b", "", None])) for f, n in (("long", 3000), ("short", 3), (None, 50)) for i in range(n) if rng.random() < 0.9 and not 500 < i < 900]
    marks = spark.createDataFrame(rows, "file string, seq long, start_ms double, label string").cache()
    as_set = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = intervals.starts_to_intervals(marks, span=None)
    merged = intervals.collapse_adjacent(whole, span=None)
    gold, hyp = intervals.boundaries(merged), intervals.boundaries(whole.filter("seq % 7 = 0 AND file = 'long'"))
    gaps = as_set(intervals.nearest_gaps(gold, hyp, span=None))
    assert len(gaps) > 500
    for span in (1, 7, 64, 1 << 16):
        assert as_set(intervals.starts_to_intervals(marks, span=span)) == as_set(whole)
        assert as_set(intervals.collapse_adjacent(whole, span=span)) == as_set(merged)
        assert as_set(intervals.nearest_gaps(gold, hyp, span=span * 9.0)) == gaps


def test_metrics_by_file_and_label_of_one_call(spark):
    gold = spark.createDataFrame([("f", i, i * 100.0, i * 100.0 + 100, "ab"[i % 2]) for i in range(20)], "file string, seq long, start_ms double, end_ms double, label string")
    hyp = gold.withColumns({"start_ms": F.col("start_ms") + 10, "end_ms": F.col("end_ms") + 10})
    files, labels = intervals.alignment_metrics(gold, hyp)
    (f,), both = files.collect(), {r.phone: r for r in labels.collect()}
    # each segment meets its own (90 of 110 ms) and, but for the first one, the one before (10 of 190 ms)
    assert abs(f.mean_iou - (20 * 90 / 110 + 19 * 10 / 190) / 39) < 1e-9 and f.tol_30ms == 1.0
    assert (both["a"]["count"], both["b"]["count"]) == (19, 20) and abs(both["b"].median_iou - (90 / 110 + 10 / 190) / 2) < 1e-9
