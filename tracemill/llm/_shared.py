"""What several operators of this subpackage need: written tables, row keys, hashed splits, counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.held import discard
from tracemill.operators.held import held as parked

__all__ = ["bytes_of", "counted", "discard", "id_text", "in_fold", "parked", "sized", "table", "texts_of"]

#: Written tables of more rows aren't broadcast by sized().
MANY = 200_000


def id_text(col: str) -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def in_fold(col: str, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(id_text(col)), F.lit(folds)) == fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(written: DataFrame, most: int = MANY) -> DataFrame:
    """``written``, to be joined by a merge if it has over ``most`` rows.

    Spark broadcasts by the size of the files, in which keys that repeat or follow each other take next to nothing; as rows in
    memory they take all their bytes.
    """
    return written.hint("merge") if written.count() > most else written


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of an Arrow batch in UTF-8, null as the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def counted(docs: DataFrame, tokens_of: Callable, name: str, flush: int = 300_000, read: Callable[[pa.RecordBatch], list] = texts_of) -> DataFrame:
    """(token, n): how often each token occurs in the texts of ``docs``, summed in each task before the shuffle.

    ``read`` gives a batch's texts, as text or as UTF-8, and ``tokens_of`` their tokens likewise. A task holds ``flush``
    distinct tokens at most before it passes its sums on.
    """
    kind = pa.binary() if read is bytes_of else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), kind).cast(pa.string()), pa.array(list(sums.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in read(batch):
                sums.update(tokens_of(text))
                if len(sums) > flush:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    parts = docs.select("text").mapInArrow(run, "token string, n long")
    return parked(parts.groupBy("token").agg(F.sum("n").alias("n")), name)
