"""Accuracy of predicted labels, and evaluation runs that go on where an earlier one ended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import extract_label, reasoning_issues
from tracemill.operators.generation import Model, generate


def judged(rows: DataFrame, truth: str = "answer", predicted: str = "pred_text", reasoning: str | None = None) -> DataFrame:
    """``rows`` with gt_label, pred_label, correct, and with the reference's ``reasoning`` also issues; a text without a label is wrong."""
    out = rows.withColumns({"gt_label": extract_label(F.col(truth)), "pred_label": extract_label(F.col(predicted))})
    out = out.withColumn("correct", F.coalesce(F.col("gt_label") == F.col("pred_label"), F.lit(False)))
    return out.withColumn("issues", reasoning_issues(F.col(reasoning), F.col(predicted))) if reasoning else out


def accuracy(rows: DataFrame, by: Sequence[str] = (), correct: str = "correct") -> DataFrame:
    """n, n_correct and accuracy, 0 for no rows, of all rows or of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"), F.coalesce(F.avg(F.coalesce(correct, F.lit(False)).cast("double")), F.lit(0.0)).alias("accuracy"))


#: The Poisson distribution of mean 1 up to 0, 1, ...: how often a row is drawn in a resample of as many rows.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def drawn(key: Column, replicate: Column) -> Column:
    """How often a row is drawn in a resample, from a hash of its key: repeatable, and the same wherever the row is."""
    u = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), replicate.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    found = F.lit(0)
    for edge in POISSON:
        found = found + F.when(u >= edge, 1).otherwise(0)
    return found


def accuracy_intervals(rows: DataFrame, key: str, by: Sequence[str] = (), correct: str = "correct", resamples: int = 200, level: float = 0.95) -> DataFrame:
    """accuracy() with low and high, the ends of the bootstrap's interval: every row counts in each resample as often as drawn() says, so all of
    them are one aggregate with a partial step, and no rows are drawn."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    each = rows.select(*by, F.col(key).alias("_key"), F.coalesce(correct, F.lit(False)).cast("int").alias("_correct"), numbers.alias("_replicate")).withColumn("_w", drawn(F.col("_key"), F.col("_replicate")))
    means = each.groupBy(*by, "_replicate").agg((F.sum(F.col("_w") * F.col("_correct")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_mean"))
    side = (1 - level) / 2
    ends = means.groupBy(*by).agg(F.percentile("_mean", F.lit(side)).alias("low"), F.percentile("_mean", F.lit(1 - side)).alias("high"))
    whole = accuracy(rows, by, correct)
    if not by:
        return whole.crossJoin(F.broadcast(ends))
    return whole.join(ends, list(by))


def evaluation_run(items: DataFrame, make_model: Callable[[], Model], folder: str, key: str, prompt: str = "prompt", parts: int = 16, batch: int = 16, most: int | None = None) -> DataFrame:
    """``items`` with pred_text, the model's answer to each prompt, written below ``folder`` in ``parts`` by a hash of the key; a part that an earlier
    run has finished is not made again. Within a task prompts go to the model in order of their length, so that batches are of like length.

    Parts are told by the marker that Spark writes last; what a run left unfinished is written anew. A run may end after ``most`` parts; it
    gives those that are there.
    """
    spark = items.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    schema = None
    for k in range(parts if most is None else min(parts, most)):
        path = f"{folder}/part={k}"
        mine = generate(items.filter(part == k).withColumn("_length", F.length(prompt)).sortWithinPartitions("_length").drop("_length"), make_model, prompt, n=1, batch=batch)
        mine = mine.withColumn("pred_text", F.col("texts")[0]).drop("texts")
        schema = schema or mine.schema
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            mine.write.mode("overwrite").parquet(path)
    there = [p for k in range(parts) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{(p := f'{folder}/part={k}')}/_SUCCESS"))]
    return spark.read.schema(schema).parquet(*there)
