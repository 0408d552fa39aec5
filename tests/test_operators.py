"""Operators on small tables, readers and writers on small files, and the queries against their SQL."""

from __future__ import annotations

import importlib.util
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import corpus, evaluation, features, generation, intervals, items, latents, selection, training
from tracemill.plans import catalogue, speech
from tracemill.sources import readers, writers
from tracemill.streaming import resume

SPANS = "file string, seq long, start_ms double, end_ms double, label string"


def test_quantiles_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0, float("nan"))], "x double")
    stats = latents.fit_row(df, ["x"])
    assert [round(v, 9) for v in stats.first()] == [1.99, 3.96]
    assert [r.x_bin for r in latents.apply(df, stats, {"x": ("low", "mid", "high")}).collect()] == ["low", "mid", "high", "high", "high"]
    none = latents.fit(spark.createDataFrame([], "x double"), ["x"]).collect()
    assert none == [] or (none[0].q33, none[0]["min"]) == (0.0, None)


def test_alignment_scores(spark):
    gold = spark.createDataFrame([("f", 1, 0.0, 100.0, "a"), ("f", 2, 100.0, 200.0, "b")], SPANS)
    hyp = spark.createDataFrame([("f", 1, 0.0, 90.0, "a"), ("f", 2, 90.0, 210.0, "b")], SPANS)
    for bucket in (None, 50.0, 1000.0):
        scored = intervals.scored_pairs(intervals.overlap_pairs(gold, hyp, bucket))
        assert scored.count() == 3
        f = intervals.by_file(scored).first()
        assert abs(f.mean_iou - 0.5936507937) < 1e-9 and abs(f.mean_start_err - 100 / 3) < 1e-6 and abs(f.mean_end_err - 130 / 3) < 1e-6
    gaps = intervals.nearest_gaps(intervals.boundaries(gold), intervals.boundaries(hyp))
    assert sorted(r.gap for r in gaps.collect()) == [0, 10, 10, 10]
    assert tuple(intervals.tolerance_rates(gaps).first())[1:] == (1.0, 1.0, 1.0)
    assert {r.gap for r in intervals.nearest_gaps(intervals.boundaries(gold), intervals.boundaries(hyp.filter("false"))).collect()} == {None}


def test_collapse(spark):
    df = spark.createDataFrame([("f", 1, 0.0, 10.0, "a"), ("f", 2, 10.0, 20.0, "a"), ("f", 3, 20.0, 30.0, "b"), ("f", 4, 31.0, 40.0, "b")], SPANS)
    assert sorted((r.start_ms, r.end_ms, r.label) for r in intervals.collapse_adjacent(df).collect()) == [(0, 20, "a"), (20, 30, "b"), (31, 40, "b")]


def test_bucketed_overlaps_equal_all_pairs(spark):
    rng = random.Random(1)
    make = lambda: [(f"f{rng.randrange(3)}", i, s := rng.uniform(0, 500), s + rng.uniform(0, 90), "x") for i in range(120)]
    a, b = make(), make()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[3] > y[2] and y[3] > x[2])
    for bucket in (None, 7.0, 100.0):
        got = intervals.overlap_pairs(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), bucket)
        assert sorted((r.g_seq, r.h_seq) for r in got.collect()) == want


def test_entry_limit_goes_beyond_by_an_entry(spark):
    df = spark.createDataFrame([(i, 2) for i in range(3)], "e int, n int")
    assert sorted(r.e for r in items.limit_entries(df, F.col("n"), 3, ["e"]).collect()) == [0, 1]
    assert items.limit_entries(df, F.col("n"), 0, ["e"]).count() == 3


def test_items(spark):
    df = spark.createDataFrame([("p", ("46-55", "male", None)), ("q", None)], "path string, speaker struct<age:string,gender:string,ethnicity:string>")
    got = items.unpivot_attributes(df, {k: items.PROMPTS[k] for k in ("gender", "age", "ethnicity")}, ["path"], speaker="speaker")
    assert [(r.path, r.answer) for r in got.orderBy("pos").collect()] == [("p", "male"), ("p", "46-55")]
    numbered = items.numbered(spark.range(1000).select((F.lit(999) - F.col("id")).alias("k")), ["k"])
    assert [r.idx for r in numbered.orderBy("k").collect()] == list(range(1000))
    twice = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, x int")
    assert items.not_done(twice, twice.filter("k = 'b'"), ["k"]).count() == 2
    with pytest.raises(ValueError):
        items.resolve_transcript(F.lit("x"), None, force=True)
    assert spark.range(1).select(items.resolve_transcript(F.lit(""), F.lit("heard"))).first()[0] == ""


def test_selection_policies(spark):
    rows = [("i", 0, "t0", True, False, "r0", []), ("i", 1, "t1", True, True, None, []), ("j", 0, "u0", False, None, None, ["bad"]), ("j", 1, "u1", False, None, None, ["x"])]
    df = spark.createDataFrame(rows, "key string, k int, text string, hard boolean, soft_passed boolean, soft_reason string, violations array<string>")
    first = {r.key: r for r in selection.finalise(selection.first_passing(df, ["key"], F.col("hard"))).collect()}
    assert (first["i"].validation_status, first["i"].generated_reasoning, first["i"].fail_reason) == ("fail", "t0", "r0")
    assert (first["j"].validation_status, first["j"].generated_reasoning, first["j"].fail_reason) == ("fail", "u0", "Hard Fail: ['bad']")
    best = {r.key: r for r in selection.finalise(selection.first_passing(df, ["key"], F.col("hard"), F.col("soft_passed"), policy="best")).collect()}
    assert (best["i"].validation_status, best["i"].generated_reasoning) == ("pass", "t1")


def test_training_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2], [1, 2, 3, 4, 5]), (1, [9], [9, 8])], "batch int, prompt_ids array<int>, full_ids array<int>")
    ex = training.to_examples(df)
    assert [r.labels for r in ex.collect()] == [[-100, -100, 3, 4, 5], [-100, 8]]
    padded = training.pad_batches(ex, pad_id=4).collect()
    assert padded[0].labels == [-100, -100, 3, -100, 5] and padded[1].input_ids == [9, 8, 4, 4, 4] and padded[1].attention_mask == [1, 1, 0, 0, 0]


def test_accuracy_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "answer string, pred_text string")
    assert tuple(evaluation.accuracy(evaluation.judged(df)).first()) == (0, 0, 0.0)


def test_generation_and_extraction(spark):
    df = spark.createDataFrame([("a",), (None,)], "model_prompt string")
    got = selection.explode_candidates(generation.generate(df, generation.stub_model, n=2)).collect()
    assert len(got) == 4 and all(r.text.endswith("</RESPONSE>") for r in got)
    t = np.arange(16000) / 16000
    f = features.signal_features(0.3 * np.sin(2 * np.pi * 200 * t))
    assert abs(f["pitch_median"] - 200) < 3 and f["duration"] == 1.0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.phones").write_text("header\n0.100000  122 SIL\n0.250000  122 aa;*\n0.400000  122 {B_TRANS}\n")
    (tmp_path / "a/y.TextGrid").write_text('name = "phones"\nxmin = 0.0\nxmax = 0.1\ntext = "a"\nxmin = 0.1\nxmax = 0.2\ntext = ""\n')
    rows = sorted((r.start_ms, r.end_ms, r.label) for r in readers.alignments(spark, str(tmp_path / "a")).collect())
    assert rows == [(0.0, 100.0, "a"), (100.0, 250.0, "SIL"), (250.0, 400.0, "aa")]
    phones = readers.whole_texts(spark, str(tmp_path / "a"), ("textgrid",)).select(readers.textgrid_phones("text").alias("p")).first().p
    assert [(p.phoneme, round(p.duration, 3)) for p in phones] == [("a", 0.1), ("", 0.1)]
    (tmp_path / "h.txt").write_text("# c\n\n p1_p2_x \n")
    assert [r.handle for r in readers.handles(spark, str(tmp_path / "h.txt")).collect()] == ["p1_p2_x"]
    (tmp_path / "s.json").write_text('[{"audio_path": "x.wav", "speaker": {"age": "1"}}]')
    assert readers.json_array(spark, str(tmp_path / "s.json"), split="train").first().speaker.age == "1"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.json_array(spark, str(tmp_path / "none.json"))
    (tmp_path / "w").mkdir()
    x = np.sin(np.arange(1600) / 9) * 0.5
    (tmp_path / "w/x.WAV").write_bytes(writers.encode_wav(x))
    (tmp_path / "w/bad.wav").write_bytes(b"no")
    got = {r.path[-7:]: r.samples for r in readers.audio(spark, str(tmp_path / "w")).collect()}
    assert got["bad.wav"] is None and np.abs(np.array(got["w/x.WAV"]) - x).max() < 1e-3
    df = spark.createDataFrame([("u1", "é text"), ("u2", "b")], "utt_id string, text string")
    assert {r.status for r in writers.write_utterances(df, str(tmp_path / "utt")).collect()} == {"CREATED"}
    assert sorted(p.name for p in (tmp_path / "utt").iterdir()) == ["u1.lab", "u2.lab"] and (tmp_path / "utt/u1.lab").read_text() == "é text\n"
    assert {r.status for r in writers.write_utterances(df, str(tmp_path / "utt")).collect()} == {"SKIPPED"}
    writers.append_json(df, str(tmp_path / "out"))
    writers.append_json(df, str(tmp_path / "out"))
    assert readers.json_lines(spark, str(tmp_path / "out"), "utt_id string, text string").count() == 4
    log = spark.createDataFrame([("COPY", "a", "b")], "status string, source string, dest string")
    writers.append_log(log, str(tmp_path / "log"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "log")).columns == ["timestamp", "status", "source", "dest"]


def test_copies_are_made_once_and_overwrite_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("p1_p2_x.wav", "p1_p3_y.wav"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    (tmp_path / "out/train/audio/p1/p3").mkdir(parents=True)
    handles = spark.createDataFrame([("p1_p2_x",), ("p1_p3_y",), ("p1_p4_z",)], "handle string")
    audio = readers.files(spark, str(tmp_path / "in")).select("path")
    audio = audio.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("stem"), F.lit("wav").alias("ext"), "path")
    plan = corpus.copy_plan(handles, audio)
    target = tmp_path / "out" / plan.filter("handle = 'p1_p3_y'").first().dest
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(b"old")
    done = writers.copy_files(plan, str(tmp_path / "out"))
    for _ in range(2):
        assert {r.handle: (r.status, r.code) for r in done.collect()} == {"p1_p2_x": ("COPY", 0), "p1_p3_y": ("EXISTS", 1), "p1_p4_z": ("MISSING", 2)}
    x = tmp_path / "out" / plan.filter("handle = 'p1_p2_x'").first().dest
    assert x.read_bytes() == b"p1_p2_x.wav" and target.read_bytes() == b"old" and len(list(x.parent.iterdir())) == 1
    assert {r.status for r in writers.copy_files(corpus.copy_plan(handles, audio, dry_run=True), str(tmp_path / "dry")).collect()} == {"DRY-RUN", "MISSING"}
    assert not (tmp_path / "dry").exists()


def test_resuming_reads_and_writes_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    run = lambda: resume.run_incremental(spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "mark"), ["id"], lambda b: b)
    run()
    spark.range(5, 15).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(15))


def test_corpora(spark):
    a = spark.createDataFrame([("/x/train/dr2/spk/a.wav",)], "file_path string")
    b = spark.createDataFrame([("/e/p1/emo_joy_sent.wav",)], "file_path string")
    both = corpus.union_corpora([corpus.describe_files(a, "timit", corpus.timit_fields), corpus.describe_files(b, "ears", corpus.ears_fields)])
    rows = {r.dataset: r for r in both.collect()}
    assert both.columns[:11] == list(corpus.META)
    assert (rows["timit"].dialect, rows["ears"].emotion, rows["ears"].speaker_id, rows["ears"].accent) == ("northern", "joy", "p1", "")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    import sys

    spec = importlib.util.spec_from_file_location("verify", __file__.replace("test_operators.py", "verify.py"))
    verify = sys.modules.get("verify") or importlib.util.module_from_spec(spec)
    if "verify" not in sys.modules:
        sys.modules["verify"] = verify
        spec.loader.exec_module(verify)
    said = verify.compare(spark, verify.duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name, catalogue.QUERIES[name], catalogue.ORACLES.get(name))
    assert said.startswith("same"), said


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 50) if i % 3 else "" for i in range(1, 3001)]
    (tmp_path / "transcripts.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.TXT").write_text("a\r\nb")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.numbered_lines(spark, str(tmp_path), ("txt",)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line_no, r.line) for r in got if r.path.endswith("transcripts.txt")) == list(enumerate(lines, 1))
    assert sorted((r.line_no, r.line) for r in got if r.path.endswith("TXT")) == [(1, "a"), (2, "b")]


def test_medians_by_label(spark):
    rng = np.random.default_rng(1)
    rows = [(p, float(x)) for p, n in (("a", 7), ("b", 8), ("c", 5), ("d", 401)) for x in rng.integers(0, 9, n) / 8]
    got = {r.phone: r for r in intervals.by_label(spark.createDataFrame(rows, "g_label string, iou double")).collect()}
    assert sorted(got) == ["a", "b", "d"]
    for p, r in got.items():
        own = [x for q, x in rows if q == p]
        assert (r["count"], r.median_iou) == (len(own), float(np.median(own))) and abs(r.mean_iou - np.mean(own)) < 1e-12


def test_formants_of_two_resonances(spark):
    rate, f = 16000, (700.0, 1220.0)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1e-3, rate)
    for hz in f:
        r, w = np.exp(-np.pi * 80 / rate), 2 * np.pi * hz / rate
        y = np.zeros(len(x) + 2)
        for i in range(len(x)):
            y[i + 2] = x[i] + 2 * r * np.cos(w) * y[i + 1] - r * r * y[i]
        x = y[2:]
    got = features.signal_features(x / np.abs(x).max() * 0.5)
    assert abs(got["F1_mean"] - f[0]) < 120 and abs(got["F2_mean"] - f[1]) < 200
    assert features.formants(np.zeros(50)).shape == (0, 3) and np.isnan(features.formants(np.zeros(8000))).all()


def test_short_textgrids():
    text = '"ooTextFile"\n"TextGrid"\n0\n1\n<exists>\n2\n"IntervalTier"\n"words"\n0\n1\n1\n0\n1\n"hi"\n"IntervalTier"\n"phones"\n0\n1\n3\n0\n0.25\n"a"\n0.25\n0.5\n""\n0.5'
    assert readers.tiers(text) == [("words", [(0.0, 1.0, "hi")]), ("phones", [(0.0, 0.25, "a"), (0.25, 0.5, "")])]
    assert readers.tiers('"IntervalTier"\n"phones"') == [] and readers.tiers("") == []


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_waves_of_any_width_and_rate(width):
    import io
    import wave

    t = np.arange(32000) / 32000
    low, high = 0.4 * np.sin(2 * np.pi * 500 * t), 0.4 * np.sin(2 * np.pi * 12000 * t)
    whole = np.round((low + high) * (1 << (8 * width - 1)) * 0.99).astype(np.int64)
    raw = (whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(32000)
        w.writeframes(raw)
    x = readers.decode_wav(out.getvalue())
    # the tone that 16 kHz can't hold is gone, the other one is there
    assert len(x) == 16000 and np.abs(x - 0.99 * low[::2]).max() < 0.02 + 1 / (1 << (8 * width - 1))


def test_equal_utterances_have_equal_scalars_and_traits(spark, tmp_path):
    rng = random.Random(7)
    kinds = ("view", "click", "purchase", "signup", "error")
    spoken = [[(rng.choice(kinds), round(rng.expovariate(0.02), 2)) for _ in range(40)] for _ in range(3)]
    # nine users, three of each kind; a user's events are parted between the files at a place of its own
    rows = [(1000 * u + k, u, *e, k >= 7 * (u // 3) + 11 * (u % 2)) for u in range(9) for k, e in enumerate(spoken[u % 3])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, late boolean")
    for late in (False, True):
        df.filter(F.col("late") == late).drop("late").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    found = [tuple(r)[1:] for r in speech.scalars(spark, str(tmp_path)).orderBy("user_id").collect()]
    assert found == found[:3] * 3
    traits = [tuple(r)[1:] for r in speech.latent_traits(spark, str(tmp_path)).orderBy("user_id").collect()]
    assert traits == traits[:3] * 3
