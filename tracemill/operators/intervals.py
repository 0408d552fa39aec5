"""Time intervals of aligned segments: building, merging, overlap join, nearest boundaries, alignment metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import quantiles
from tracemill.operators.held import held

#: Tolerances in milliseconds, and the count that a label must exceed to be reported.
TOLERANCES = (30, 50, 70)
LEAST_SEGMENTS = 5


#: Marks of a file that one task looks at together, by their numbers: a longer file is several ranges.
SPAN = 1 << 16


def _ranged(rows: DataFrame, order: str, span: float | None) -> DataFrame:
    """``rows`` with the range of ``order`` in which they lie; without ``span`` a file is one range."""
    return rows.withColumn("_range", F.floor(F.col(order) / span).cast("long") if span else F.lit(0).cast("long"))


def _carried(local: DataFrame, file: str, **carries: tuple[Column, str]) -> DataFrame:
    """``local``, whose rows have a file and a _range, with what other ranges of the file pass on.

    Each of ``carries`` is an aggregate of a range, with a direction: "last" gives a range the last value that is not null of those before it,
    "next" the first of those behind it. Only a row for each range meets the others.
    """
    each = local.groupBy(file, "_range").agg(*[c.alias(name) for name, (c, _) in carries.items()])
    w = Window.partitionBy(file).orderBy("_range")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    found = [(F.last(name, ignorenulls=True).over(before) if way == "last" else F.first(name, ignorenulls=True).over(behind)).alias(name) for name, (_, way) in carries.items()]
    met = each.select(F.col(file).alias("_f"), F.col("_range").alias("_r"), *found)
    return local.join(met, F.col(file).eqNullSafe(F.col("_f")) & F.col("_range").eqNullSafe(F.col("_r"))).drop("_f", "_r")


def starts_to_intervals(marks: DataFrame, file: str = "file", seq: str = "seq", start: str = "start_ms", label: str = "label", span: float | None = SPAN) -> DataFrame:
    """Each mark lasts until the next one of its file by ``seq``; the last has no end and goes, then those without a label go.

    A file is looked at in ranges of ``span`` numbers, each of which passes its first mark to the one before.
    """
    w = Window.partitionBy(file, "_range").orderBy(seq)
    if not span:
        local = _ranged(marks, seq, span).withColumn("end_ms", F.lead(start).over(w))
    else:
        here = _ranged(marks, seq, span).withColumns({"_next": F.lead(F.struct(start)).over(w)})
        local = _carried(here, file, _first=(F.min_by(F.struct(start), seq), "next")).withColumn("end_ms", F.coalesce("_next", "_first")[start])
    return local.drop("_range", "_next", "_first").filter(F.col("end_ms").isNotNull() & (F.coalesce(label, F.lit("")) != ""))


def collapse_adjacent(spans: DataFrame, gap: float = 1e-6, file: str = "file", seq: str = "seq", start: str = "start_ms", end: str = "end_ms", label: str = "label", span: float | None = SPAN) -> DataFrame:
    """(file, seq, start, end, label): neighbours of one label that touch within ``gap`` are one interval.

    Ranges of a file pass on their last interval and where the island that is still open began, so an island may reach over many.
    """
    w = Window.partitionBy(file, "_range").orderBy(seq)
    here = _ranged(spans, seq, span).withColumn("_before", F.lag(F.struct(label, end)).over(w))
    if span:
        here = _carried(here, file, _last=(F.max_by(F.struct(label, end), seq), "last")).withColumn("_before", F.coalesce("_before", "_last"))
    same = (F.col("_before")[label] == F.col(label)) & (F.abs(F.col(start) - F.col("_before")[end]) < gap)
    marked = here.withColumn("_break", F.when(~F.coalesce(same, F.lit(False)), F.col(seq)))
    # an island has the number of its first interval
    marked = marked.withColumn("_island", F.last("_break", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if span:
        marked = _carried(marked, file, _open=(F.max("_break"), "last")).withColumn("_island", F.coalesce("_island", "_open"))
    return marked.groupBy(file, "_island").agg(F.min(seq).alias(seq), F.min_by(start, seq).alias(start), F.max_by(end, seq).alias(end), F.min_by(label, seq).alias(label)).drop("_island")


#: Milliseconds of a time bucket: longer than nearly all segments, and few segments of a file lie in one.
BUCKET = 10_000.0


def overlap_pairs(gold: DataFrame, hyp: DataFrame, bucket: float | None = BUCKET, file: str = "file", start: str = "start_ms", end: str = "end_ms", label: str = "label") -> DataFrame:
    """Pairs of a gold and a hypothesis interval of one file that share more than a point: the columns with g_ and h_ before.

    Intervals are joined by file and time bucket, so that a long file is not one key: both sides are spread over the buckets
    they touch, and a pair is taken in the bucket where its overlap begins, hence once. Without ``bucket`` the file is the key.
    """
    side = lambda df, p: df.select(F.col(file).alias(f"{p}file"), *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != file])
    g, h = side(gold, "g_"), side(hyp, "h_")
    gs, ge, hs, he = (F.col(f"{p}{c}") for p in ("g_", "h_") for c in (start, end))
    on = (F.col("g_file") == F.col("h_file")) & (ge > hs) & (he > gs)
    if bucket:
        at = lambda c: F.floor(c / bucket).cast("long")
        g = g.filter(ge > gs).withColumn("g_bucket", F.explode(F.sequence(at(gs), at(ge))))
        h = h.filter(he > hs).withColumn("h_bucket", F.explode(F.sequence(at(hs), at(he))))
        on = on & (F.col("g_bucket") == F.col("h_bucket")) & (at(F.greatest(gs, hs)) == F.col("g_bucket"))
    return g.join(h, on).drop("h_file", "g_bucket", "h_bucket").withColumnRenamed("g_file", file)


def overlap(gs: Column, ge: Column, hs: Column, he: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(ge, he) - F.greatest(gs, hs))


def iou(gs: Column, ge: Column, hs: Column, he: Column) -> Column:
    """Overlap over hull; 0 if the hull is empty."""
    hull = F.greatest(F.lit(0.0), F.greatest(ge, he) - F.least(gs, hs))
    return F.when(hull > 0, overlap(gs, ge, hs, he) / hull).otherwise(F.lit(0.0))


def scored_pairs(pairs: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """``pairs`` with iou, overlap, start_err, end_err."""
    gs, ge, hs, he = (F.col(f"{p}{c}") for p in ("g_", "h_") for c in (start, end))
    return pairs.withColumns({"iou": iou(gs, ge, hs, he), "overlap": overlap(gs, ge, hs, he), "start_err": F.abs(gs - hs), "end_err": F.abs(ge - he)})


def by_file(scored: DataFrame, file: str = "file") -> DataFrame:
    return scored.groupBy(file).agg(F.avg("start_err").alias("mean_start_err"), F.avg("end_err").alias("mean_end_err"), F.avg("iou").alias("mean_iou"))


def by_label(scored: DataFrame, least: int = LEAST_SEGMENTS, label: str = "g_label") -> DataFrame:
    """(phone, mean_iou, median_iou, count) of labels with more than ``least`` pairs.

    The pairs are made once; medians are exact and come from sketches by label and what lies in their brackets, so that a label
    with very many pairs is never held in memory.
    """
    pairs = held(scored.select(F.col(label).alias("phone"), "iou"), "pairs")
    often = pairs.groupBy("phone").agg(F.avg("iou").alias("mean_iou"), F.count("*").alias("count"), *quantiles.sums_of(F.col("iou"), F.count("iou"))).filter(F.col("count") > least)
    sums = held(often, "labels")
    middle = quantiles.exact(pairs, sums, [0.5], ["phone"], "iou").select("phone", F.col("value").alias("median_iou"))
    return sums.join(middle, "phone", "left").select("phone", "mean_iou", "median_iou", "count")


def confusion(scored: DataFrame) -> DataFrame:
    """How long each gold label and each hypothesis label go together."""
    return scored.groupBy("g_label", "h_label").agg(F.sum("overlap").alias("overlap_ms"))


def macro_mean(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the mean over files of each metric, without NaN and null."""
    return files.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns])


def boundaries(spans: DataFrame, file: str = "file", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(file, t): both ends of every interval; a boundary that two share counts twice."""
    return spans.select(file, F.explode(F.array(start, end)).alias("t"))


#: Milliseconds of a range in which the boundaries of a file are sorted together.
RANGE = 3_600_000.0


def nearest_gaps(gold: DataFrame, hyp: DataFrame, file: str = "file", span: float | None = RANGE) -> DataFrame:
    """(file, t, gap): for each gold boundary the distance to the nearest hypothesis boundary of its file, null if there is none.

    One sort of both sides by time, in ranges of ``span`` milliseconds that pass on their first and last hypothesis boundary: the last
    boundary before and the first one after, so no pair is made.
    """
    both = gold.select(file, "t", F.lit(True).alias("_gold")).unionByName(hyp.select(file, "t", F.lit(False).alias("_gold")))
    local = _ranged(both, "t", span)
    at = F.when(~F.col("_gold"), F.col("t"))
    w = Window.partitionBy(file, "_range").orderBy("t")
    before = F.last(at, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(at, ignorenulls=True).over(Window.partitionBy(file, "_range").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    met = local.withColumns({"_before": before, "_after": after})
    if span:
        met = _carried(met, file, _last=(F.max(at), "last"), _first=(F.min(at), "next")).withColumns({"_before": F.coalesce("_before", "_last"), "_after": F.coalesce("_after", "_first")})
    return met.filter("_gold").select(file, "t", F.least(F.col("t") - F.col("_before"), F.col("_after") - F.col("t")).alias("gap"))


def rates(tolerances: Sequence[int] = TOLERANCES) -> list[Column]:
    """Aggregates of gaps: the share up to each tolerance, null without any."""
    return [F.avg((F.col("gap") <= t).cast("double")).alias(f"tol_{t}ms") for t in tolerances]


def tolerance_rates(gaps: DataFrame, tolerances: Sequence[int] = TOLERANCES, file: str = "file") -> DataFrame:
    """By file the shares of gold boundaries with a gap up to each tolerance; null if the file has no gap."""
    return gaps.groupBy(file).agg(*rates(tolerances))


def file_metrics(gold: DataFrame, merged: DataFrame, scored: DataFrame) -> DataFrame:
    """The metrics by file, of files in both, of collapsed hypothesis intervals and the scored pairs of both sides."""
    common = gold.select("file").distinct().join(merged.select("file").distinct(), "file", "left_semi")
    return common.join(by_file(scored), "file", "left").join(tolerance_rates(nearest_gaps(boundaries(gold), boundaries(merged))), "file", "left")


def sides(gold: DataFrame, hyp: DataFrame, bucket: float | None = BUCKET, span: float | None = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gold side, the collapsed hypothesis side and their scored pairs, each written once."""
    gold, merged = held(gold, "gold"), held(collapse_adjacent(hyp, span=span), "merged")
    return gold, merged, held(scored_pairs(overlap_pairs(gold, merged, bucket)), "scored")


def alignment_metrics(gold: DataFrame, hyp: DataFrame, bucket: float | None = BUCKET, span: float | None = SPAN) -> tuple[DataFrame, DataFrame]:
    """The metrics by file, of files in both, and by label; hypothesis intervals are collapsed first."""
    gold, merged, scored = sides(gold, hyp, bucket, span)
    return file_metrics(gold, merged, scored), by_label(scored)
