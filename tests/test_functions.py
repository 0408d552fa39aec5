"""Column helpers on small inputs whose results are known."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tracemill.functions import paths, phonology, text, validation
from tracemill.plans import traces
from tracemill.sources import readers


def one(spark, column, **values):
    """The value of an expression over a row of texts."""
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "said, label",
    [
        ("X most consistent with: A. Most Consistent With: Male.", "male"),
        ("The speaker\nit is old", "old"),
        ("plain", "plain"),
        ("male .", "male "),
        ("so most consistent with: b\nc.\n</RESPONSE>", "b\nc.\n</response>"),
        ("  \n ", None),
        ("a b is C..", "c"),
    ],
)
def test_extract_label(spark, said, label):
    assert one(spark, text.extract_label(F.col("t")), t=said) == label


def test_strip_and_tags(spark):
    assert one(spark, text.strip(F.col("t")), t=" \t x \n") == "x"
    assert one(spark, text.ensure_closing_tag(F.col("t")), t="a ") == "a\n</RESPONSE>"
    assert one(spark, text.ensure_closing_tag(F.col("t")), t="a</RESPONSE>\n") == "a</RESPONSE>"
    assert one(spark, text.final_answer_tail(F.col("t")), t="x<FINAL_ANSWER> y </FINAL_ANSWER>") == "y </FINAL_ANSWER>"
    assert one(spark, text.verdict(F.col("t")), t="It PASSES") is True
    assert one(spark, text.verdict(F.col("t")), t="pass, fail") is None


def answer(traits, label):
    return f"Based on features such as {traits}, the speaker is most consistent with: {label}."


def trace(think, response):
    return f"<THINK>{think}</THINK> <RESPONSE>{response}</RESPONSE>"


GOOD = "f0_level=low, voice_stability=unstable"
SEXES = ["female", "male"]
REGIONS = ["army brat (moved around)", "northern", "western"]


@pytest.mark.parametrize(
    "said, candidates, n, first",
    [
        (trace("f0_level=low", answer(GOOD, "male")), SEXES, 0, None),
        (trace("f0_level=low", answer(GOOD, "female")), SEXES, 0, None),
        (trace("f0_level=low", answer(GOOD, "male")).lower().replace("based on", "Based on"), SEXES, 0, None),
        (answer(GOOD, "male"), SEXES, 1, "Format Error"),
        (trace("  ", answer(GOOD, "male")), SEXES, 1, "Format Error"),
        (trace("about 120 Hz and 5 MS f0_level=low", answer(GOOD, "male")), SEXES, 1, "Forbidden pattern found: Hz"),
        (trace("f0_level=high f0_level=high", answer(GOOD, "male")), SEXES, 2, "Invalid trait in THINK: f0_level=high"),
        (trace("x", answer("f0_level=low", "male")), SEXES, 1, "Insufficient traits in RESPONSE: Found 1, expected at least 2."),
        (trace("x", answer("f0_level=high, speaking_rate=fast", "male")), SEXES, 1, "Invalid trait in RESPONSE: f0_level=high"),
        (trace("x", "It is consistent with: male. Yes"), SEXES, 1, "Response Template Error: Structure"),
        (trace("x", "male"), SEXES, 1, "Response Template Error: Must"),
        (trace("x", answer(GOOD, "army brat (moved around)")), REGIONS, 1, "Invalid Label: 'army brat moved around'"),
        (trace("x", answer(GOOD, "army brat")), REGIONS, 0, None),
        (trace("x", answer(GOOD, "the northern region")), REGIONS, 0, None),
        (trace("x", answer(GOOD, "western")), ["northern"], 1, "Invalid Label"),
        (trace("x", answer(GOOD, "male")), [], 1, "Invalid Label"),
        (None, SEXES, 1, "Format Error"),
    ],
)
def test_hard_rules(spark, said, candidates, n, first):
    pairs = F.array(*map(F.lit, ("f0_level=low", "voice_stability=unstable", "speaking_rate=fast")))
    choices = F.array(*map(F.lit, candidates)) if candidates else F.array().cast("array<string>")
    found = one(spark, validation.violations(F.col("t"), pairs, choices), t=said)
    assert len(found) == n and (first is None or found[0].startswith(first)), found


@pytest.mark.parametrize(
    "reply, passed, reason",
    [
        ("{}", True, None),
        ('{"checks": {"a": true}, "violations": []}', True, None),
        ('{"checks": {"a": true, "b": false}}', False, "Soft checks failed"),
        ('{"checks": {"a": true,}, "violations": [],}', True, None),
        ('ok ```json\n{"checks": {"a": true}}\n``` bye', True, None),
        ('```\n{"checks": {}}\n```', False, "Soft Val JSON Parse Error"),
        ('{"violations": [{"rule": "x"}]}', False, '[{"rule":"x"}]'),
        ("[1]", False, "Soft Val JSON Parse Error"),
        (None, False, "Soft Val JSON Parse Error"),
    ],
)
def test_soft_verdict(spark, reply, passed, reason):
    got = one(spark, validation.soft_verdict(F.col("t")), t=reply)
    assert got.passed is passed and (got.reason is None if reason is None else got.reason.startswith(reason)), got


def test_phone_scalars(spark):
    phones = [("æ1", 0.1), ("", 0.2), ("m̩", 0.1), ("aj0", 0.2), ("7", 0.1), ("ɹ", 0.1), ("t", 0.1), ("spn", 0.1)]
    df = spark.createDataFrame([(phones,)], "p array<struct<phoneme:string,duration:double>>")
    got = df.select(*[c.alias(n) for n, c in phonology.phone_scalars(F.col("p")).items()]).first().asDict()
    want = {"articulation_rate": 5 / 0.6, "mean_phone_dur": 0.12, "vowel_ratio": 0.4, "rhotic_ratio": 0.2, "diphthong_ratio": 0.5, "pause_rate": 3.0, "has_syllabic": 1.0}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    none = spark.createDataFrame([(None,)], df.schema).select(*[c.alias(n) for n, c in phonology.phone_scalars(F.col("p")).items()]).first()
    assert set(none) == {0.0}


def test_acoustic_scalars(spark):
    df = spark.createDataFrame([({"pitch_mean": 118.77, "pitch_median": 91.83, "F1_mean": 843.0, "F2_mean": 1852.03, "energy_max": 60.0, "energy_min": 10.0},)], "f map<string,double>")
    got = df.select(*[c.alias(n) for n, c in phonology.acoustic_scalars(F.col("f")).items()]).first()
    assert abs(got.f0_skew_proxy - 26.94) < 1e-9 and got.jitter == 0 and got.energy_var_proxy == 50
    assert abs(got.vowel_space_scale - math.log(1852.03 / 843)) < 1e-12


def test_names_and_paths(spark):
    e = one(spark, paths.emotion_name(F.col("t")), t="emo_a_b_c.wav")
    assert (e.emotion, e.speech_type) == ("a_b", "c")
    s = one(spark, paths.slice_name(F.col("t")), t="rainbow_03_highpitch_0_153653.wav")
    assert (s.base, s.start, s.end) == ("rainbow_03_highpitch", 0, 153653)
    assert one(spark, paths.slice_name(F.col("t")), t="rainbow.wav") is None
    d = one(spark, paths.dialect_path(F.col("t")), t="x\\TRAIN\\DR4\\FMLD0\\SA1.wav")
    assert tuple(d) == ("fmld0", "dr4", "south_midland", "train")
    assert one(spark, paths.with_suffix(F.col("t"), ".AF"), t="a.b/c.wav") == "a.b/c.AF"
    assert one(spark, paths.language_of(F.col("t")), t="mls_polish") == "polish"
    assert one(spark, paths.language_of(F.col("t")), t="dutch_low_resource") == "dutch"
    h = one(spark, paths.handle_parts(F.col("t")), t="1_22_333_4")
    assert tuple(h) == ("1", "22", "333_4")


def test_lines(spark):
    assert one(spark, readers.first_line_text(F.col("t")), t="0 6190 She had your suit\nmore") == "She had your suit"
    assert one(spark, readers.first_line_text(F.col("t")), t="She") == "She"
    assert tuple(one(spark, readers.tabbed_transcript(F.col("t")), t="u 1\ta b")) == ("u 1", "a b")
    assert one(spark, readers.tabbed_transcript(F.col("t")), t="alone") is None
    assert tuple(one(spark, readers.id_and_text(F.col("t")), t=" id ")) == ("id", "")
    assert one(spark, readers.feature_map(F.col("t")), t='{"a": 1.5, "b": "2"}') == {"a": 1.5, "b": 2.0}
    assert one(spark, readers.feature_map(F.col("t")), t='{"a": 1.5, "b": null}') == {}
    assert one(spark, readers.feature_map(F.col("t")), t="no") == {}


def test_a_label_is_worked_out_once(spark, tmp_path):
    rows = [(k, "red ring", "b", "ECONOMY", k, 1.0) for k in range(16)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    found = traces.label_fuzzy(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<RESPONSE>(.*?)") == 1 and plan.count("[^a-zA-Z0-9") <= 2
    got = {r.p_partkey: (r.lab, r.fits) for r in found.collect()}
    assert [got[k] for k in range(8)] == [("economy", True), (None, None), ("economy", True), ("economy", True), ("economy", True), (None, None), ("nothing such", False), ("economy", True)]
