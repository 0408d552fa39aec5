"""Alignment queries: users stand for files, events for marks; even events are the gold side, odd ones the hypothesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import intervals
from tracemill.plans.registry import query, table

DAY = 86_400_000.0

_MARKS = "m AS (SELECT user_id AS file, event_id AS seq, epoch_us(ts)::DOUBLE / 1000 AS start_ms, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS label FROM events)"
_SPANS = "{0} AS (SELECT * FROM (SELECT *, lead(start_ms) OVER (PARTITION BY file ORDER BY seq) AS end_ms FROM m WHERE {1}) WHERE end_ms IS NOT NULL AND label <> '')"
_COLLAPSE = """{0} AS (SELECT file, min(seq) AS seq, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, arg_min(label, seq) AS label FROM (
    SELECT *, sum(brk) OVER (PARTITION BY file ORDER BY seq) AS island FROM (
        SELECT *, CASE WHEN lag(label) OVER w = label AND abs(start_ms - lag(end_ms) OVER w) < 1e-6 THEN 0 ELSE 1 END AS brk FROM {1} WINDOW w AS (PARTITION BY file ORDER BY seq)))
    GROUP BY file, island)"""
_PAIRS = """p AS (SELECT g.file, g.label AS gl, c.label AS hl, g.start_ms gs, g.end_ms ge, c.start_ms hs, c.end_ms he FROM g JOIN c ON g.file = c.file AND g.end_ms > c.start_ms AND c.end_ms > g.start_ms),
    s AS (SELECT *, greatest(0, least(ge, he) - greatest(gs, hs)) AS o, greatest(0, least(ge, he) - greatest(gs, hs)) / (greatest(ge, he) - least(gs, hs)) AS iou, abs(gs - hs) AS se, abs(ge - he) AS ee FROM p)"""
_ALL = ", ".join((_MARKS, _SPANS.format("g", "seq % 2 = 0"), _SPANS.format("h", "seq % 2 = 1"), _COLLAPSE.format("c", "h"), _PAIRS))
_BOUNDS = "gb AS (SELECT file, start_ms AS t FROM g UNION ALL SELECT file, end_ms FROM g), hb AS (SELECT file, start_ms AS t FROM c UNION ALL SELECT file, end_ms FROM c), d AS (SELECT gb.file, gb.t, min(abs(gb.t - hb.t)) AS gap FROM gb LEFT JOIN hb ON gb.file = hb.file GROUP BY gb.file, gb.t)"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("start_ms"), label.alias("label"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.starts_to_intervals(marks(spark, sf_dir).filter("seq % 2 = 0"))


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.collapse_adjacent(intervals.starts_to_intervals(marks(spark, sf_dir).filter("seq % 2 = 1")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.scored_pairs(intervals.overlap_pairs(gold(spark, sf_dir), hypothesis(spark, sf_dir), bucket=DAY))


@query("starts_to_intervals", f"WITH {_MARKS}, {_SPANS.format('i', 'true')} SELECT file, seq, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, label FROM i")
def starts_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.starts_to_intervals(marks(spark, sf_dir)).select("file", "seq", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "label")


@query("collapse_adjacent", f"WITH {_MARKS}, {_SPANS.format('i', 'true')}, {_COLLAPSE.format('c', 'i')} SELECT file, seq, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, label FROM c")
def collapse_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.collapse_adjacent(intervals.starts_to_intervals(marks(spark, sf_dir))).select("file", "seq", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "label")


@query("overlap_join", f"WITH {_ALL} SELECT file, gl, hl, round(gs, 3) AS gs, round(hs, 3) AS hs, round(o, 2) AS overlap_ms, round(iou, 6) AS iou FROM s")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("file", F.col("g_label").alias("gl"), F.col("h_label").alias("hl"), F.round("g_start_ms", 3).alias("gs"), F.round("h_start_ms", 3).alias("hs"), F.round("overlap", 2).alias("overlap_ms"), F.round("iou", 6).alias("iou"))


@query("iou_by_file", f"WITH {_ALL} SELECT file, round(avg(se), 2) AS mean_start_err, round(avg(ee), 2) AS mean_end_err, round(avg(iou), 6) AS mean_iou FROM s GROUP BY file")
def iou_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.by_file(scored(spark, sf_dir)).select("file", F.round("mean_start_err", 2).alias("mean_start_err"), F.round("mean_end_err", 2).alias("mean_end_err"), F.round("mean_iou", 6).alias("mean_iou"))


@query("iou_by_label", f"WITH {_ALL} SELECT gl AS phone, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, count(*) AS count FROM s GROUP BY gl HAVING count(*) > 5")
def iou_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.by_label(scored(spark, sf_dir)).select("phone", F.round("mean_iou", 6).alias("mean_iou"), F.round("median_iou", 6).alias("median_iou"), "count")


@query("top_bottom_labels", f"WITH {_ALL}, l AS (SELECT file AS phone, round(avg(iou), 6) AS mean_iou FROM s GROUP BY file HAVING count(*) > 5) (SELECT 'low' AS side, * FROM l ORDER BY mean_iou, phone LIMIT 10) UNION ALL (SELECT 'high', * FROM l ORDER BY mean_iou DESC, phone DESC LIMIT 10)")
def top_bottom_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = intervals.by_label(scored(spark, sf_dir), label="file").select("phone", F.round("mean_iou", 6).alias("mean_iou"))
    low = labels.orderBy("mean_iou", "phone").limit(10).select(F.lit("low").alias("side"), "*")
    return low.unionByName(labels.orderBy(F.desc("mean_iou"), F.desc("phone")).limit(10).select(F.lit("high").alias("side"), "*"))


@query("confusion_weighted", f"WITH {_ALL} SELECT gl AS g_label, hl AS h_label, round(sum(o), 1) AS overlap_ms FROM s GROUP BY gl, hl")
def confusion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.confusion(scored(spark, sf_dir)).withColumn("overlap_ms", F.round("overlap_ms", 1))


@query("macro_mean", f"WITH {_ALL}, f AS (SELECT file, avg(se) AS se, avg(iou) AS iou FROM s GROUP BY file) SELECT round(avg(se), 2) AS mean_start_err, round(avg(iou), 6) AS mean_iou FROM f")
def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = intervals.macro_mean(intervals.by_file(scored(spark, sf_dir)), ["mean_start_err", "mean_iou"])
    return files.select(F.round("mean_start_err", 2).alias("mean_start_err"), F.round("mean_iou", 6).alias("mean_iou"))


@query("boundary_tolerance", f"WITH {_ALL}, {_BOUNDS} SELECT gb.file, count(*) AS n, round(avg(gap), 2) AS mean_gap, round(avg((gap <= 30)::INT), 6) AS tol_30ms, round(avg((gap <= 50)::INT), 6) AS tol_50ms, round(avg((gap <= 7200000)::INT), 6) AS tol_2h FROM gb JOIN d ON gb.file = d.file AND gb.t = d.t GROUP BY gb.file")
def boundary_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = intervals.nearest_gaps(intervals.boundaries(gold(spark, sf_dir)), intervals.boundaries(hypothesis(spark, sf_dir)))
    found = gaps.groupBy("file").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 2).alias("mean_gap"), *intervals.rates((30, 50, 7_200_000)))
    return found.select("file", "n", "mean_gap", F.round("tol_30ms", 6).alias("tol_30ms"), F.round("tol_50ms", 6).alias("tol_50ms"), F.round("tol_7200000ms", 6).alias("tol_2h"))


@query("alignment_metrics", f"WITH {_ALL}, {_BOUNDS}, r AS (SELECT gb.file, round(avg((gap <= 70)::INT), 6) AS tol_70ms FROM gb JOIN d ON gb.file = d.file AND gb.t = d.t GROUP BY gb.file), f AS (SELECT file, round(avg(iou), 6) AS mean_iou FROM s GROUP BY file) SELECT x.file, mean_iou, tol_70ms FROM (SELECT file FROM g INTERSECT SELECT file FROM c) x LEFT JOIN f ON x.file = f.file LEFT JOIN r ON x.file = r.file")
def alignment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.file_metrics(*intervals.sides(gold(spark, sf_dir), hypothesis(spark, sf_dir), bucket=DAY))
    return found.select("file", F.round("mean_iou", 6).alias("mean_iou"), F.round("tol_70ms", 6).alias("tol_70ms"))
