"""The bounded sample of labelled documents that a classifier learns from, and the table it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import discard, id_text, in_fold, parked, texts_of


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, y) of at most ``rows`` labelled documents, whole texts, the first in the order of their ids' hashes.

    Ids whose crc32 modulo ``folds`` is ``held`` are left out, as are null ids and labels. An id with several labels takes 1
    if most of them are. Rows with the same id count once, with the smallest text. ``key`` is the id as text.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.filter(~in_fold("id", folds, held)).groupBy("id").agg(F.avg("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # labels of documents that aren't there take no place in the sample
    chosen = known.join(texts.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64(id_text("id")), "id").limit(rows)
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return parked(found.select(id_text("id").alias("key"), "text", (F.col("y") > 0.5).cast("double").alias("y")), "sample")


class Texts:
    """The labelled texts of a sample, in the order of their keys, for a learner on the driver.

    Up to ``held_chars`` characters in all they are held there; more are read again for each pass over them, some at a time, in
    the order asked for. What is learnt is the same.
    """

    def __init__(self, found: DataFrame, held_chars: int, at_once: int = 64):
        self.found, self.at_once, self.texts = found, at_once, None
        rows = sorted(found.select("key", "y", F.length("text").alias("n")).collect(), key=lambda r: r.key)
        self.keys, self.y = [r.key for r in rows], np.array([r.y for r in rows])
        if sum(r.n for r in rows) <= held_chars:
            self.texts = [r.text for r in sorted(found.select("key", "text").collect(), key=lambda r: r.key)]

    def __len__(self) -> int:
        return len(self.keys)

    def read(self, order: np.ndarray) -> Iterator[tuple[str, float]]:
        """(text, label) of the rows that ``order`` numbers, one after another."""
        if self.texts is not None:
            yield from ((self.texts[i], self.y[i]) for i in order)
            return
        spark = self.found.sparkSession
        places = spark.createDataFrame([(self.keys[i], k // self.at_once, k) for k, i in enumerate(order.tolist())], "key string, part int, place int")
        # written once, so that one part after another can be fetched
        parts = parked(self.found.select("key", "text").join(F.broadcast(places), "key").repartitionByRange(max(1, len(order) // self.at_once), "part"), "turn", **{"parquet.block.size": str(1 << 22)})
        for k in range(-(-len(order) // self.at_once)):
            for r in sorted(parts.filter(F.col("part") == k).select("place", "text").collect(), key=lambda r: r.place):
                yield r.text, self.y[order[r.place]]
        discard(parts)


def scored(docs: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], threshold: float, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. ``model()`` gives, in a task, the function from texts to scores."""
    rows = docs.select(F.col(id_col).alias("id"), in_fold(id_col, folds, held).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model()
        for batch in batches:
            scores = np.asarray(of(texts_of(batch)), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
