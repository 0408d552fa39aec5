"""Exact quantiles of many groups in two scans: a mergeable sketch, then only what lies in the brackets that it gives.

The first scan keeps a KLL sketch for each group, a fixed number of bytes whatever the number of rows; sketches of several
runs can be merged. A sketch tells a value's rank but for a small error, hence a bracket around each rank asked for. The second
scan counts what lies below, between and above the brackets, and the distinct values within them. A sketch's error has no
certain bound, so it is looked up whether each rank did fall in its bracket; if not, brackets are widened and scanned again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.held import held

#: The size parameter of sketches, some 100 KB each.
SKETCH = 4096
#: Brackets with so many distinct values together are ranked by one window for each; with more, by ranges.
BY_WINDOW = 1_000_000


def sketched(rows: DataFrame, group: Sequence[str] = ("scalar",), value: str = "v", weight: str | None = None) -> DataFrame:
    """(group, sketch, n, min, max): one row for each group; null values don't count, without any the sketch is null and n 0.

    A ``weight`` says how often a row counts. Rows go to a sketch for each binary digit of their weight, and a sketch merged with
    itself counts twice.
    """
    v = F.col(value)
    if weight is None:
        return rows.groupBy(*group).agg(*sums_of(v, F.count(v)))
    w = F.when(v.isNotNull(), F.col(weight).cast("long"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(w, b) == 1)
    digits = rows.withColumn("_bit", F.explode(F.when(w > 0, bits).otherwise(F.array(F.lit(0).cast("int")))))
    v = F.when(w > 0, v)
    each = digits.groupBy(*group, "_bit").agg(*sums_of(v, F.count(v)))
    part = F.map_from_entries(F.collect_list(F.when(F.col("n") > 0, F.struct("_bit", "sketch"))))
    whole = each.groupBy(*group).agg(part.alias("parts"), F.sum(F.expr("n * shiftleft(1L, _bit)")).cast("long").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))

    def double_and_add(so_far: Column, bit: Column) -> Column:
        one = F.element_at("parts", bit)
        twice = F.kll_sketch_merge_double(so_far, so_far)
        return F.when(so_far.isNull(), one).when(one.isNull(), twice).otherwise(F.kll_sketch_merge_double(twice, one))

    sketch = F.aggregate(F.sequence(F.lit(62), F.lit(0)), F.lit(None).cast("binary"), double_and_add)
    return whole.select(*group, sketch.alias("sketch"), "n", "min", "max")


def sums_of(v: Column, n: Column) -> list[Column]:
    return [F.when(n > 0, F.kll_sketch_agg_double(v, SKETCH)).alias("sketch"), n.alias("n"), F.min(v).alias("min"), F.max(v).alias("max")]


def merged(tables: Sequence[DataFrame], group: Sequence[str] = ("scalar",)) -> DataFrame:
    """The sketches of several runs as if of one."""
    every = reduce(DataFrame.unionByName, tables)
    n = F.sum("n")
    return every.groupBy(*group).agg(F.when(n > 0, F.kll_merge_agg_double("sketch")).alias("sketch"), n.alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))


def estimated(found: DataFrame, qs: Sequence[float], group: Sequence[str] = ("scalar",)) -> DataFrame:
    """(group, q, value) from sketches alone, without a second scan."""
    each = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in qs])
    return found.filter("n > 0").select(*group, F.inline(each))


def _brackets(found: DataFrame, qs: Sequence[float], group: Sequence[str], error: float) -> DataFrame:
    """(group, n, low, high): arrays of the brackets' ends, one for each of ``qs`` in their order."""
    few = F.col("n") <= SKETCH  # a small group is its own bracket, so that places and shares differ by 1 / SKETCH at most
    wide = error + 1 / SKETCH
    low = [F.when(few | F.lit(q <= wide), F.col("min")).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(max(q - wide, 0.0)))) for q in qs]
    high = [F.when(few | F.lit(q >= 1 - wide), F.col("max")).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(min(q + wide, 1.0)))) for q in qs]
    return found.filter("n > 0").select(*group, "n", F.array(*low).alias("_low"), F.array(*high).alias("_high"))


def exact(rows: DataFrame, found: DataFrame, qs: Sequence[float], group: Sequence[str] = ("scalar",), value: str = "v", weight: str | None = None, few: bool = False, error: float = 2.5 / SKETCH**0.9) -> DataFrame:
    """(group, q, value): the quantiles of the groups that have values, interpolated between neighbours; ``found`` has their sketches.

    ``few`` says that the number of groups has a bound, so that their brackets are broadcast. ``rows`` is read once for each try.
    """
    qs = sorted(float(q) for q in qs)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    while True:
        brackets = _brackets(found, qs, group, error)
        v = F.col(value)
        # even regions lie outside the brackets, odd ones are brackets
        region = F.when(v < F.col("_low")[0], 0)
        for i in range(len(qs)):
            region = region.when(v < F.col("_low")[i], 2 * i).when(v <= F.col("_high")[i], 2 * i + 1)
        region = region.otherwise(2 * len(qs))
        near = rows.filter(v.isNotNull() & (w > 0)).join(F.broadcast(brackets) if few else brackets, list(group))
        inside = F.when(F.col("_region") % 2 == 1, v)
        counts = held(near.select(*group, v, w.alias("_w"), region.alias("_region")).groupBy(*group, "_region", inside.alias("v")).agg(F.sum("_w").alias("n")), "brackets")
        sums = counts.groupBy(*group, "_region").agg(F.sum("n").alias("_m"), F.count("*").alias("_values"))
        order = Window.partitionBy(*group).orderBy("_region")
        places = sums.withColumn("_upto", F.sum("_m").over(order)).withColumn("_all", F.sum("_m").over(Window.partitionBy(*group)))
        wanted = places.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs]))).withColumn("place", F.col("q") * (F.col("_all") - 1) - (F.col("_upto") - F.col("_m")))
        here = wanted.filter("floor(place) >= 0 AND floor(place) < _m").select(*group, "_region", "q", "place", "_values", (F.expr("_region % 2 = 1") & (F.ceil("place") < F.col("_m"))).alias("_met"))
        here = rows.sparkSession.createDataFrame(here.collect(), here.schema) if few else held(here, "wanted")
        said = here.agg(F.count_if(~F.col("_met")).alias("missed"), F.sum("_values").alias("values")).first()
        if not said.missed:
            return _picked(counts.filter("v IS NOT NULL"), here.select(*group, "_region", "q", "place"), [*group, "_region"], said["values"] or 0).select(*group, "q", "value")
        error *= 8


def _picked(counts: DataFrame, wanted: DataFrame, group: Sequence[str], values: int) -> DataFrame:
    """(group, q, value): the value at each wanted (group, q, place) of (group, v, n)."""
    if values > BY_WINDOW:
        return by_rank(counts, wanted, group)
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    met = counts.withColumn("upto", upto).join(wanted, list(group)).filter((F.col("upto") > F.floor("place")) & (F.col("upto") - F.col("n") <= F.ceil("place")))
    return _between(met, group)


def _between(met: DataFrame, group: Sequence[str]) -> DataFrame:
    share = F.max(F.col("place") - F.floor("place"))
    low, high = F.min("v"), F.max("v")
    return met.groupBy(*group, "q").agg((low + (high - low) * share).alias("value"))


def by_rank(counts: DataFrame, wanted: DataFrame, group: Sequence[str]) -> DataFrame:
    """As the window, by ranges: values are sorted in ranges, the ranges' sums say which of them hold the ranks asked for, and only
    these are numbered. Memory is that of a sort, whatever the number of distinct values."""
    group = list(group)
    ranged = held(counts.repartitionByRange(*group, "v").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*group, "part").agg(F.sum("n").alias("m"))
    before = sums.withColumn("before", F.sum("m").over(Window.partitionBy(*group).orderBy("part")) - F.col("m"))
    here = wanted.join(before, group).filter("before <= ceil(place) AND floor(place) < before + m").select(*group, "q", "place", "part", "before")
    upto = F.sum("n").over(Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    numbered = ranged.join(here.select(*group, "part").distinct(), [*group, "part"]).withColumn("upto", upto)
    met = numbered.join(here, [*group, "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    return _between(met.filter((F.col("upto") > F.floor("place")) & (F.col("upto") - F.col("n") <= F.ceil("place"))), group)
