"""Entries of JSON arrays of any size: a file is read in splits, and what a split must know of those before it is a few sums.

A file is cut at every closing brace, wherever Spark splits it. Whether a piece begins within a string is the parity of the
quotes before it, how deep it lies the difference of braces outside strings, and which entry it belongs to the number
of times that depth came back to 0. All three are running sums: worked out within each split, with the sums of the splits
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.sources.readers import PREPARED


def _running(pieces: DataFrame, value: Column, name: str, current: bool) -> DataFrame:
    """``pieces`` with the sum of ``value`` over the pieces of the file before each one, or up to it with ``current``."""
    rows = pieces.withColumn("_v", value)
    inside = F.sum("_v").over(Window.partitionBy("path", "_at").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    whole = rows.groupBy("path", "_at").agg(F.sum("_v").alias("_m"))
    before = whole.select("path", "_at", F.coalesce(F.sum("_m").over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    summed = rows.withColumn("_inside", inside).join(before, ["path", "_at"])
    return summed.withColumn(name, F.col("_before") + F.col("_inside") - (F.lit(0) if current else F.col("_v"))).drop("_v", "_inside", "_before")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def entry_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, text): the objects of the arrays in the files at ``path``, numbered from 0 within their file."""
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("piece"))
    # what follows a backslash is neither a quote nor a brace
    clean = F.regexp_replace("piece", r"(?s)\\.", "")
    outside = lambda text: F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")
    from_string = F.regexp_replace(clean, r'(?s)^[^"]*("|$)', "")
    last = F.lead("_id").over(Window.partitionBy("path", "_at").orderBy("_id")).isNull()
    splits = pieces.groupBy("path", "_at").agg(F.lit(1).alias("_one"))
    ends = splits.select("path", "_at", F.lead("_at").over(Window.partitionBy("path").orderBy("_at")).isNull().alias("_end"))
    rows = pieces.withColumns({"_quotes": _count(clean, '"') % 2, "_open0": _count(outside(clean), "{"), "_open1": _count(outside(from_string), "{"), "_last": last})
    rows = rows.join(ends, ["path", "_at"]).withColumn("_final", F.col("_last") & F.col("_end"))
    rows = _running(rows, F.col("_quotes"), "_parity", current=False).withColumn("_string", F.col("_parity") % 2 == 1)
    ended = (F.col("_parity") + F.col("_quotes")) % 2 == 1
    rows = rows.withColumn("_close", F.when(ended | F.col("_final"), 0).otherwise(1))
    opened = F.when(F.col("_string"), F.col("_open1")).otherwise(F.col("_open0"))
    rows = _running(rows, opened - F.col("_close"), "_depth", current=True).withColumn("_closed", F.when((F.col("_close") == 1) & (F.col("_depth") == 0), 1).otherwise(0))
    rows = _running(rows, F.col("_closed"), "entry", current=False)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id", "piece"))), lambda x: x["piece"])
    whole = rows.groupBy("path", "entry").agg(parts.alias("parts"), F.max("_closed").alias("_closed")).filter("_closed = 1")
    text = F.regexp_replace(F.concat(F.concat_ws("}", "parts"), F.lit("}")), r"^[\s,\[\x{FEFF}]*", "")
    return whole.select("path", "entry", text.alias("text"))


def json_entries(spark: SparkSession, path: str, schema: str = PREPARED, split: str | None = None) -> DataFrame:
    """As readers.json_array(), for files of any size: no task reads more than a split. Fields that no one asks for aren't parsed; an entry
    that can't be parsed has null fields."""
    rows = entry_texts(spark, path).select(F.from_json("text", schema).alias("x")).select("x.*")
    return rows if split is None else rows.withColumn("split", F.lit(split))
