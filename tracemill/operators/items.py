"""Question and answer items: unpivoted attributes, limits, transcripts, blocklist, candidates, resuming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import one_of
from tracemill.operators.held import held

#: What is asked of each attribute, in order.
PROMPTS = {
    "gender": "What is the speaker's gender?",
    "age": "What is the speaker's age?",
    "dialect_region": "What is the speaker's dialect?",
    "ethnicity": "What is the speaker's ethnicity?",
}
#: The answers to choose from, by the word in the prompt that asks for them, in the order in which the words are tried.
CANDIDATES = {
    "gender": ("female", "male"),
    "age": ("18-25", "26-35", "36-45", "46-55", "56-65", "66-75"),
    "dialect": ("army brat (moved around)", "new england", "new york city", "north midland", "northern", "south midland", "southern", "western"),
    "ethnicity": ("asian", "black or african american", "hispanic or latino", "white or caucasian"),
}
#: Answers that make no item.
BLOCKED = ("prefer not to answer", "non-binary / third gender", "unknown")


def unpivot_attributes(entries: DataFrame, attributes: Mapping[str, str], keep: Sequence[str], speaker: str | None = None) -> DataFrame:
    """One row for each entry and attribute that has a value: ``keep``, attribute, prompt, answer (as text), pos.

    ``attributes`` gives each attribute's prompt, in order; ``speaker`` is the struct that holds them, if one does.
    """
    value = lambda a: (F.col(speaker)[a] if speaker else F.col(a)).cast("string")
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("attribute"), F.lit(p).alias("prompt"), value(a).alias("answer")) for i, (a, p) in enumerate(attributes.items())])
    return entries.select(*keep, F.explode(F.filter(rows, lambda r: r["answer"].isNotNull())).alias("_item")).select(*keep, "_item.*")


def limit_entries(entries: DataFrame, n_items: Column, limit: int | None, order: Sequence[str]) -> DataFrame:
    """The entries before which fewer than ``limit`` items come, so the last one may go beyond; 0 and None mean all.

    The order is one over all rows, as the limit asks. The rows are dealt in ranges of it, each range's items are summed,
    and only these sums, a row for each of Spark's partitions, meet in one place.
    """
    if not limit:
        return entries
    rows = held(entries.withColumn("_n", n_items).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = rows.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = ranges.select("_range", before.alias("_before")).filter(F.col("_before") < limit)
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(started), "_range").withColumn("_inside", inside).filter(F.col("_before") + F.col("_inside") < limit).select(*entries.columns)


def resolve_transcript(transcript: Column, spoken: Column | None, force: bool = False, fallback: bool = True) -> Column:
    """The transcript, or what a recogniser hears where there is none; an empty transcript is one.

    ``force`` always asks the recogniser; without ``fallback`` a missing transcript is an error, as is a missing recogniser.
    """
    if (force or fallback) and spoken is not None:
        return spoken if force else F.coalesce(transcript, spoken)
    if force:
        raise ValueError("a recogniser is needed")
    return F.coalesce(transcript, F.raise_error(F.lit("no transcript and no recogniser")).cast("string"))


def drop_blocked(items: DataFrame, answer: str = "answer", blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """Without items whose answer is blocked; a missing answer stays."""
    return items.filter(~one_of(F.col(answer), blocked))


def candidates_for(prompt: Column, candidates: Mapping[str, Sequence[str]] = CANDIDATES) -> Column:
    """The candidates of the first word that the prompt holds anywhere, even within a longer word; none without one."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    out = F.array().cast("array<string>")
    for word, values in reversed(list(candidates.items())):
        out = F.when(low.contains(word), F.array(*map(F.lit, values))).otherwise(out)
    return out


def not_done(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The items whose keys are not among those done; items that repeat each other stay."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti").select(*items.columns)


def first_of_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by ``order``, by a map-side minimum instead of a sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)


def first_n_of_group(rows: DataFrame, n: int | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; None means all."""
    if n is None:
        return rows
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """``rows`` with their place by ``order``, from 0, without a sort of all rows in one task: ranges are sorted each by itself,
    and only the number of rows of each range meets the others."""
    ranged = held(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + F.col("_inside") - 1).cast("long").alias(name))


def batched(rows: DataFrame, size: int, order: Sequence[str], name: str = "batch", index: str | None = None) -> DataFrame:
    """``rows`` with the number of their batch of ``size`` rows by ``order``, and their place as ``index`` if it has a name."""
    found = numbered(rows, order, index or "_idx").withColumn(name, F.floor(F.col(index or "_idx") / size).cast("long"))
    return found if index else found.drop("_idx")


def sample_k(rows: DataFrame, k: int, key: str, seed: int = 11785) -> DataFrame:
    """``k`` rows at random, always the same for a seed: those whose hashed keys are smallest."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(k)
