"""Fine-tuning examples as arrays: label masks, truncation, padding by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import chat_turns
from tracemill.operators.held import held

#: The label that no loss counts, and the longest example.
IGNORED = -100
LONGEST = 4096


def mask_prompt(ids: Column, prompt_length: Column) -> Column:
    """The ids as labels, with IGNORED for those of the prompt; no longer than the ids."""
    n = F.least(prompt_length.cast("int"), F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.size(ids)))


def truncate(values: Column, longest: int = LONGEST) -> Column:
    return F.slice(values, 1, longest)


def pad(values: Column, length: Column, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(length - F.size(values), F.lit(0))))


def pad_batches(examples: DataFrame, pad_id: int, batch: str = "batch", ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Ids and labels padded to the longest of their batch, with attention_mask; every pad id among the labels is IGNORED, even
    if it is a token of the text."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    rows = examples.withColumn("_longest", longest)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_longest") - F.size(ids)))
    filled = F.transform(pad(F.col(labels), F.col("_longest"), pad_id), lambda x: F.when(x == pad_id, F.lit(IGNORED)).otherwise(x))
    return rows.withColumns({"attention_mask": mask, ids: pad(F.col(ids), F.col("_longest"), pad_id), labels: filled}).drop("_longest")


#: Examples of one batch differ in length by no more than this factor; so many examples of like length are dealt together.
LIKE, DEALT = 1.125, 50_000


def budget_batches(examples: DataFrame, budget: int, length: str, key: str, name: str = "batch", dealt: int = DEALT) -> DataFrame:
    """``examples`` with a batch number, so that the longest of a batch times their number is at most ``budget``; an example longer than that is a
    batch of its own, null lengths count as 0.

    Lengths fall into ranges of a factor of LIKE, a range into groups of about ``dealt`` by a hash of the key. Within a group, sorted by
    length, batches are filled one after another. Only the groups' numbers of batches meet to make numbers that follow each other.
    """
    size = F.greatest(F.coalesce(F.col(length), F.lit(0)).cast("long"), F.lit(1).cast("long"))
    rows = examples.withColumn("_size", size).withColumn("_range", F.floor(F.log("_size") / F.log(F.lit(LIKE))).cast("int"))
    # a range for each eighth of length: a few hundred at most
    groups = rows.groupBy("_range").agg(F.ceil(F.count("*") / dealt).alias("_groups"))
    rows = rows.join(F.broadcast(groups), "_range").withColumn("_group", F.pmod(F.xxhash64(key), F.col("_groups")).cast("int"))

    def filled(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_size", key], ascending=False, kind="stable")
        sizes, batches, start, number = group["_size"].to_numpy(), [], 0, 0
        while start < len(sizes):
            n = max(1, int(budget // sizes[start]))
            batches += [number] * min(n, len(sizes) - start)
            start, number = start + n, number + 1
        return pd.DataFrame({key: group[key], "_range": group["_range"], "_group": group["_group"], "_size": group["_size"], "_local": batches})

    kind = examples.schema[key].dataType.simpleString()
    local = held(rows.select(key, "_range", "_group", "_size").groupBy("_range", "_group").applyInPandas(filled, f"`{key}` {kind}, _range int, _group int, _size long, _local long"), "batches")
    sums = local.groupBy("_range", "_group").agg((F.max("_local") + 1).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.groupBy("_range").agg(F.sum("_n").alias("_m"))
    base = ranges.select("_range", F.coalesce(F.sum("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    before = sums.withColumn("_first", first).join(F.broadcast(base), "_range")
    numbers = local.join(before, ["_range", "_group"]).select(key, (F.col("_base") + F.col("_first") + F.col("_local")).cast("long").alias(name))
    return examples.join(numbers, key)


def padded_share(batches: DataFrame, length: str, batch: str = "batch") -> DataFrame:
    """One row: batches, tokens, padded (tokens with padding), and padded_share, the part of it that is padding."""
    each = batches.groupBy(batch).agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.sum(length).alias("tokens"))
    tokens, padded = F.sum("tokens"), F.sum(F.col("n") * F.col("longest"))
    return each.agg(F.count("*").alias("batches"), tokens.alias("tokens"), padded.alias("padded"), (1 - tokens / padded).alias("padded_share"))


def pad_time(examples: DataFrame, batch: str = "batch", features: str = "input_features") -> DataFrame:
    """[C, T] features padded with zeros to the longest T of their batch, with feature_attention_mask."""
    own = F.size(F.col(features)[0])
    rows = examples.withColumn("_own", own).withColumn("_longest", F.max("_own").over(Window.partitionBy(batch)))
    more = F.col("_longest") - F.col("_own")
    filled = F.transform(features, lambda channel: F.concat(channel, F.array_repeat(F.lit(0.0).cast("float"), more)))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("_own")), F.array_repeat(F.lit(0), more))
    return rows.withColumns({features: filled, "feature_attention_mask": mask}).drop("_own", "_longest")


def to_examples(rows: DataFrame, prompt_ids: str = "prompt_ids", full_ids: str = "full_ids", longest: int = LONGEST) -> DataFrame:
    """input_ids and labels, truncated, of rows with the ids of the prompt and of the whole exchange; other columns but these stay."""
    labels = mask_prompt(F.col(full_ids), F.size(prompt_ids))
    return rows.withColumns({"input_ids": truncate(F.col(full_ids), longest), "labels": truncate(labels, longest)}).drop(prompt_ids, full_ids)


#: An encoder takes conversations, each a list of (role, content), and whether the assistant is to go on; it gives their ids.
Encoder = Callable[[Sequence[list[tuple[str, str]]], bool], list[list[int]]]


def encoded_chats(rows: DataFrame, make_encoder: Callable[[], Encoder], prompt: str = "prompt", answer: str = "response") -> DataFrame:
    """``rows`` with prompt_ids (the user's turn, up to where the assistant goes on) and full_ids (both turns), as to_examples()
    takes them: the length of the prompt is that of its own ids. The encoder is made once for each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for f in frames:
            turns = lambda column: [[(t["role"], t["content"] or "") for t in x] for x in f[column]]
            out = f.drop(columns=["_asked", "_told"])
            out["prompt_ids"], out["full_ids"] = encode(turns("_asked"), True), encode(turns("_told"), False)
            yield out

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    asked = rows.withColumns({"_asked": chat_turns(F.col(prompt)), "_told": chat_turns(F.col(prompt), F.col(answer))})
    return asked.mapInPandas(run, f"{fields}, prompt_ids array<int>, full_ids array<int>")


def byte_encoder() -> Encoder:
    """An encoder without a vocabulary, for tests: role, a line end, content and a line end in UTF-8."""

    def encode(chats: Sequence[list[tuple[str, str]]], go_on: bool) -> list[list[int]]:
        return [list("".join(f"{role}\n{content}\n" for role, content in turns).encode() + (b"assistant\n" if go_on else b"")) for turns in chats]

    return encode
