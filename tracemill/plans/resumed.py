"""Run queries: arrays read by split, batches under a budget of tokens, one pass of features, ledgers of what is done, evaluation runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import evaluation, generation, items, runs, training
from tracemill.operators.held import held, new_path
from tracemill.plans.registry import query, table
from tracemill.plans.traces import _JUDGED, answers
from tracemill.sources import json_arrays, writers
from tracemill.streaming.resume import Ledger


@query("json_entries_scan", """SELECT c_custkey AS id, c_name || ' "}{' || chr(92) || chr(10) || c_mktsegment AS note, c_nationkey AS n, c_custkey // 2000 AS file FROM customer""")
def json_entries_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of up to 2,000 entries, with braces, quotes, backslashes and line breaks in their texts, read by split."""
    note = F.concat("c_name", F.lit(' "}{\\\n'), "c_mktsegment")
    entry = F.struct(F.col("c_custkey").alias("id"), note.alias("note"), F.struct(F.col("c_nationkey").alias("n"), F.array(F.struct(F.lit(1).alias("x"))).alias("more")).alias("in"))
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 2000).alias("file"), entry.alias("x"))
    files = rows.groupBy("file").agg(F.to_json(F.collect_list("x")).alias("content")).withColumn("name", F.concat(F.col("file").cast("string"), F.lit(".json")))
    folder = new_path(spark, "arrays")
    writers.write_files(files, folder).count()
    found = json_arrays.json_entries(spark, folder, "id long, note string, in struct<n:int,more:array<struct<x:int>>>")
    return found.select("id", "note", F.col("in.n").alias("n"), F.floor(F.col("id") / 2000).alias("file"))


@query("token_budget_batches", "SELECT count(*) AS examples, sum(1 + n_chars // 4)::BIGINT AS tokens, true AS once, true AS within, true AS less_padding, true AS numbered FROM documents")
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8,192 padded tokens at most, against batches of 200 rows in their order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (1 + F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens"))
    found = held(training.budget_batches(rows, 8192, "tokens", "doc_id"), "batched")
    each = found.groupBy("batch").agg(F.count("*").alias("n"), F.max("tokens").alias("longest"))
    within = each.agg(F.every((F.col("n") * F.col("longest") <= 8192) | (F.col("n") == 1)).alias("within"), (F.max("batch") + 1 == F.count("*")).alias("numbered"))
    whole = found.agg(F.count("*").alias("examples"), F.sum("tokens").alias("tokens"), (F.count_distinct("doc_id") == F.count("*")).alias("once"))
    old = training.padded_share(items.batched(rows, 200, ["doc_id"]), "tokens").select(F.col("padded_share").alias("old"))
    shares = training.padded_share(found, "tokens").crossJoin(old).select((F.col("padded_share") < F.col("old")).alias("less_padding"))
    return whole.crossJoin(within).crossJoin(shares)


@query("feature_run", "SELECT vec_id::VARCHAR AS path, label, 0.05 AS duration, (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS failed, (SELECT round(count(*) FILTER (vec_id % 50 > 0) * 0.05, 4) FROM embeddings) AS seconds FROM embeddings WHERE vec_id % 50 > 0")
def feature_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, metadata and failures of one pass, and the counts that were taken while it was written."""
    tone = F.transform(F.sequence(F.lit(0), F.lit(799)), lambda i: F.sin(i * (2 * math.pi * 150 / 16000)) * F.col("embedding")[0])
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "label", F.when(F.col("vec_id") % 50 > 0, tone).alias("samples"))
    features, metadata, failures, counts = runs.feature_run(rows, new_path(spark, "features"), ["path", "label"])
    assert failures.columns == ["path", "error"]
    return features.join(metadata, "path").select("path", "label", F.col("values")["duration"].alias("duration"), F.lit(counts["n"]).alias("n"), F.lit(counts["failed"]).alias("failed"), F.lit(round(counts["seconds"], 4)).alias("seconds"))


@query("ledger_resume", "SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS first FROM events GROUP BY user_id")
def ledger_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events is done, then all that is left, then the second batch comes once more and adds nothing."""
    folder = new_path(spark, "ledger")
    ledger = Ledger(spark, folder, {"event_id": "bigint"}, "ledger_" + folder[-12:], buckets=8)
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    ledger.run(events.filter("event_id % 3 = 0"), 0, lambda new: new)
    for _ in range(2):
        ledger.run(events, 1, lambda new: new)
    return ledger.results().groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("batch") == 0).alias("first"))


_U = "('0x' || substr(md5(doc_id::VARCHAR || ':' || r), 1, 8))::BIGINT / 4294967296.0"
_DRAWN = " + ".join(f"(u >= {edge!r})::INT" for edge in evaluation.POISSON)


@query(
    "evaluation_intervals",
    f"""WITH j AS (SELECT doc_id, source, correct FROM ({_JUDGED})), d AS (SELECT source, r, correct, {_DRAWN} AS w FROM (SELECT *, {_U} AS u FROM j, range(100) t(r))),
    m AS (SELECT source, r, sum(w * correct::INT) / nullif(sum(w), 0) AS mean FROM d GROUP BY source, r)
    SELECT * FROM (SELECT source, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 6) AS accuracy FROM j GROUP BY source)
    JOIN (SELECT source, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY source) USING (source)""",
)
def evaluation_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.accuracy_intervals(answers(spark, sf_dir), "doc_id", ["source"], resamples=100)
    return found.select("source", "n", "n_correct", *[F.round(c, 6).alias(c) for c in ("accuracy", "low", "high")])


@query("evaluation_resumed", "SELECT role, count(*) AS n, true AS answered, true AS same FROM conversations GROUP BY role")
def evaluation_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation run, and one that ended early and is taken up again: the answers are the same."""
    rows, folder = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("prompt")), new_path(spark, "evaluation")
    run = lambda name: evaluation.evaluation_run(rows, generation.stub_model, f"{folder}/{name}", "id", parts=4)
    whole = run("whole")
    evaluation.evaluation_run(rows, generation.stub_model, f"{folder}/early", "id", parts=4, most=2)
    again = run("early")
    met = whole.join(again.select("id", F.col("pred_text").alias("other")), "id", "left")
    return met.groupBy("role").agg(F.count("*").alias("n"), F.every(F.col("pred_text").isNotNull()).alias("answered"), F.every(F.col("pred_text").eqNullSafe(F.col("other"))).alias("same"))
