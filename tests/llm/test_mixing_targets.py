"""Raking to powers and to given targets, on the driver and as a table, also where cells run out of tokens."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
POWERS = {"source": 0.5, "lang": 0.6, "topic": 0.9}


@pytest.fixture(scope="module")
def scarce(spark):
    """Source b is small and nearly all German, so that its German cell runs out while its marginal stays within reach."""
    rng = random.Random(12)
    rows = []
    for i in range(4000):
        source = rng.choices("abc", (70, 15, 15))[0]
        lang = rng.choices(("en", "de"), (30, 70) if source == "b" else (97, 3))[0]
        rows.append((i, "word " * rng.randint(5, 40) + rng.choice(("", "", "", "@")), lang, source, 0))
    return mixing.marked(spark.createDataFrame(rows, DOCS)).cache()


def worst(found, targets, share, against="target"):
    return max(abs(r.kept - r[against]) for r in mixing.achieved(found, targets, share).collect())


def test_targets_hold_although_cells_run_out(scarce):
    here = mixing.weighted(scarce, POWERS, 0.5).cache()
    there = mixing.weighted(scarce, POWERS, 0.5, driver_cells=0).cache()
    for found in (here, there):
        assert found.filter("_rate >= 1").count() > 0 and found.agg(F.max("_rate")).first()[0] <= 1
        assert worst(found, POWERS, 0.5) < 1e-6
        total = found.agg(F.sum(F.col("_tokens") * F.col("_rate")), F.sum("_tokens")).first()
        assert abs(total[0] / total[1] - 0.5) < 1e-6
    both = here.select("doc_id", F.col("_rate").alias("a")).join(there.select("doc_id", F.col("_rate").alias("b")), "doc_id")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-7


@pytest.mark.parametrize("driver_cells", [50_000, 0])
def test_given_targets_by_mapping_and_table(spark, scarce, driver_cells):
    table = spark.createDataFrame([("en", 6.0), ("de", 1.0), ("fr", 5.0)], "value string, weight double")
    targets = {"source": {"a": 3, "b": 1, "c": 0, "never": 7}, "lang": table}
    found = mixing.weighted(scarce, targets, 0.2, driver_cells)
    kept = {(r.dimension, r.value): r.kept for r in mixing.achieved(found, targets, 0.2).collect()}
    want = {("source", "a"): 3 / 4, ("source", "b"): 1 / 4, ("source", "c"): 0.0, ("lang", "en"): 6 / 7, ("lang", "de"): 1 / 7}
    assert kept.keys() == want.keys() and all(abs(kept[k] - want[k]) < 1e-6 for k in want)


def test_a_value_that_cannot_reach_its_target_is_kept_whole(spark):
    df = mixing.marked(spark.createDataFrame([(i, "word " * 9 + ("@" if i % 50 == 0 else ""), "en", "a", 0) for i in range(1000)], DOCS))
    got = mixing.weighted(df, mixing.POWERS, 0.5)
    assert {r[0] for r in got.filter("_topic = 'contact'").select("_rate").collect()} == {1.0}
    rows = {r.value: r for r in mixing.achieved(got, mixing.POWERS, 0.5).collect() if r.dimension == "topic"}
    assert rows["contact"].kept < rows["contact"].target and abs(sum(r.kept for r in rows.values()) - 1) < 1e-9
    assert all(abs(r.kept - r.reachable) < 1e-9 for r in rows.values())


def test_topics_may_be_a_column_and_names_may_clash(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(1, 9), "en", rng.choice(("a", None)), rng.choice("xyyyyy"), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string, _rate int").withColumn("_topic", F.lit("t"))
    got = mixing.mixed(df, {"topic": {"x": 1, "y": 1}}, 0.2, topic="kind")
    assert got.columns == df.columns
    n = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    assert abs(n["x"] / (n["x"] + n["y"]) - 0.5) < 0.05
    assert mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize("driver_cells", [50_000, 0])
def test_targets_that_contradict_each_other_are_told(spark, monkeypatch, driver_cells):
    """Each source speaks one language, and the targets ask for other shares of the two."""
    monkeypatch.setattr(mixing, "TURNS", 8)
    df = mixing.marked(spark.createDataFrame([(i, "word " * 5, "en" if i % 2 else "de", "a" if i % 2 else "b", 0) for i in range(100)], DOCS))
    with pytest.warns(UserWarning, match="contradict"):
        found = mixing.weighted(df, {"source": {"a": 1, "b": 3}, "lang": {"en": 3, "de": 1}}, 0.2, driver_cells)
    assert found.off > 0.01
    assert mixing.weighted(df, {"source": {"a": 1, "b": 3}, "lang": {"en": 1, "de": 3}}, 0.2, driver_cells).off <= mixing.TOLERANCE
