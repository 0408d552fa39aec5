"""Arrays read by split, batches under a budget, ledgers that survive a kill, evaluation runs."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import evaluation, generation, runs, training
from tracemill.sources import json_arrays, writers
from tracemill.streaming.resume import Ledger

ENTRY = "id long, note string, in struct<n:int,list:array<int>>"


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_in_splits_that_begin_anywhere(spark, tmp_path, small_splits, indent):
    rng = random.Random(1)
    bits = ["}", "{", '"', "\\", "\\\\", '\\"', "[", "],", "é", "\n", "plain", '"}', "{{", "x" * 150]
    want = [{"id": i, "note": "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))), "in": {"n": i % 5, "list": [1] * (i % 3)}} for i in range(80)]
    (tmp_path / "a.json").write_text(json.dumps(want[:60], indent=indent))
    (tmp_path / "b.json").write_text("﻿" + json.dumps(want[60:], indent=indent, ensure_ascii=False) + "\n\n")
    (tmp_path / "none.json").write_text("[]\n")
    texts = json_arrays.entry_texts(spark, str(tmp_path))
    starts = spark.read.option("lineSep", "}").text(str(tmp_path)).select("_metadata.file_block_start").distinct()
    assert starts.count() > 20 and sorted((r.path[-6:], r.entry) for r in texts.collect()) == [("a.json", i) for i in range(60)] + [("b.json", i) for i in range(20)]
    got = json_arrays.json_entries(spark, str(tmp_path), ENTRY, split="train").collect()
    assert sorted(((r.id, r.note, r["in"].n, r["in"].list, r.split) for r in got), key=lambda r: r[0]) == [(w["id"], w["note"], w["in"]["n"], w["in"]["list"], "train") for w in want]


def test_fields_that_no_one_asks_for_are_not_parsed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "note": "x"}]))
    plan = json_arrays.json_entries(spark, str(tmp_path), ENTRY).select("id")._jdf.queryExecution().optimizedPlan().toString()
    parse = next(line for line in plan.splitlines() if "from_json" in line or "JsonToStructs" in line or "StructField(id" in line)
    assert "StructField(note" not in parse


@pytest.mark.parametrize("dealt", [5, 50_000])
def test_batches_stay_within_the_budget(spark, dealt):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.lognormal(4, 1.2, 3000)] + [0, None, 5000, 100, 100, 100]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, n long")
    found = training.budget_batches(df, 2000, "n", "id", dealt=dealt)
    rows = found.collect()
    assert sorted(r.id for r in rows) == list(range(len(sizes)))
    by: dict = {}
    for r in rows:
        by.setdefault(r.batch, []).append(max(1, r.n or 0))
    assert sorted(by) == list(range(len(by)))
    assert all(len(b) * max(b) <= 2000 or len(b) == 1 for b in by.values())
    if dealt > 100:
        share = training.padded_share(found, "n").first()
        assert share.padded_share < 0.08 and share.batches < 1.25 * sum(n or 0 for n in sizes) / 2000 + 60


def test_a_ledger_goes_on_after_a_kill(spark, tmp_path):
    def ledger(name):
        return Ledger(spark, str(tmp_path / "out"), {"id": "bigint", "part": "string"}, name, buckets=4)

    rows = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("part"))
    ledger("ledger_a").run(rows.filter("id < 40"), 0, lambda new: new.withColumn("seen", F.lit(0)))
    second = ledger("ledger_b")
    calls = []

    def work(new):
        calls.append(new.count())
        return new.withColumn("seen", F.lit(1))

    # killed when results are written, and when keys are set aside: each time the batch is run again
    class Killed(Exception):
        pass

    plain = second.new
    for left in (1, 0):
        def failing(items, left=left):
            if calls:
                raise Killed
            return plain(items)

        second.new = failing
        with pytest.raises(Killed):
            second.run(rows, 1, work)
        second.new = plain
        if left:
            assert second._exists(str(tmp_path / "out/keys/batch=1/_SUCCESS")) and not second._exists(str(tmp_path / "out/added/batch=1/_SUCCESS"))
            # as if the kill had come just after the keys were added
            plain(spark.read.parquet(str(tmp_path / "out/keys/batch=1"))).repartition(4, "id", "part").write.insertInto("ledger_b")
    second.run(rows, 1, work)
    second.run(rows, 1, work)
    again = ledger("ledger_c")
    again.run(rows, 2, lambda new: new.withColumn("seen", F.lit(2)))
    got = again.results().collect()
    assert sorted(r.id for r in got) == list(range(100)) and sum(r.seen == 1 for r in got) == 60 and calls[0] == 60 and len(calls) == 1
    assert spark.table("ledger_c").count() == 100
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = again.new(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_evaluation_that_ends_early_is_taken_up(spark, tmp_path):
    rows = spark.range(200).select("id", F.concat(F.lit("q"), "id").alias("prompt"))
    part = evaluation.evaluation_run(rows, generation.stub_model, str(tmp_path / "e"), "id", parts=5, most=2)
    n = part.count()
    stamps = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "e/part=0").iterdir()}
    whole = evaluation.evaluation_run(rows, generation.stub_model, str(tmp_path / "e"), "id", parts=5)
    assert 0 < n < 200 and whole.count() == 200 and {p.name: p.stat().st_mtime_ns for p in (tmp_path / "e/part=0").iterdir()} == stamps
    other = evaluation.evaluation_run(rows, generation.stub_model, str(tmp_path / "f"), "id", parts=1)
    assert {(r.id, r.pred_text) for r in whole.collect()} == {(r.id, r.pred_text) for r in other.collect()}


def test_intervals_hold_the_truth_about_as_often_as_they_say(spark):
    rng = np.random.default_rng(3)
    rows = [(g * 1000 + i, g, bool(rng.random() < 0.7)) for g in range(60) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g int, correct boolean")
    got = evaluation.accuracy_intervals(df, "id", ["g"]).collect()
    assert len(got) == 60 and all(r.low <= r.accuracy <= r.high and 0.08 < r.high - r.low < 0.18 for r in got)
    assert sum(r.low <= 0.7 <= r.high for r in got) >= 51
    (one,) = evaluation.accuracy_intervals(df, "id").collect()
    assert one.n == 12_000 and one.high - one.low < 0.025
    draws = df.select(evaluation.drawn(F.col("id"), F.lit(7)).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(draws[0] - 1) < 0.03 and abs(draws[1] - 1) < 0.06


def test_counts_are_taken_while_writing(spark, tmp_path):
    got = writers.write_observed(spark.range(10), str(tmp_path / "o"), n=F.count("*"), top=F.max("id"))
    assert got == {"n": 10, "top": 9} and spark.read.parquet(str(tmp_path / "o")).count() == 10


def test_features_metadata_and_failures_of_one_pass(spark, tmp_path):
    rows = [("a", "s1", [0.0, 0.1] * 800), ("b", "s2", None), ("c", None, [0.0] * 1600)]
    df = spark.createDataFrame(rows, "path string, speaker string, samples array<double>")
    features, meta, failures, counts = runs.feature_run(df, str(tmp_path / "f"), ["path", "speaker"])
    assert {r.path for r in features.collect()} == {"a", "c"} and {tuple(r) for r in meta.collect()} == {("a", "s1"), ("c", None)}
    assert [tuple(r) for r in failures.collect()] == [("b", "no samples")] and counts == {"n": 3, "failed": 1, "seconds": 0.2}
