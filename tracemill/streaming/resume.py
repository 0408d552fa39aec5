"""Resumable runs: new files of a folder are read once, items that are done are left out, the rest is appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracemill.operators.items import not_done


def done_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier runs have written; nothing if there was none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run_batch(items: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """Applies ``work`` to the items whose keys ``path`` lacks and appends what it returns."""
    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    work(not_done(items, done_items(items.sparkSession, path, schema), keys)).write.mode("append").parquet(path)


def run_incremental(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], files_at_once: int = 1000, glob: str = "*") -> None:
    """run_batch() over the files of the folder ``source`` with names like ``glob`` that no earlier call has read, some at a time; returns when all are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", glob).parquet(source)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer.foreachBatch(lambda batch, _: run_batch(batch, path, keys, work)).start().awaitTermination()


class Ledger:
    """Results of a resumable run with the keys that are done in buckets, so that only new items move to meet them, and each batch in a folder
    of its own, so that a batch that is run again replaces itself.

    Below ``path``: results/batch=N, and done, a table of keys in ``buckets`` by hash. ``name`` is the table's name in the session.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], name: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.name, self.buckets = spark, path, keys, name, buckets
        columns, names = ", ".join(f"`{k}` {t}" for k, t in keys.items()), ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({names}) INTO {buckets} BUCKETS LOCATION '{path}/done'")

    def new(self, items: DataFrame) -> DataFrame:
        """The items whose keys aren't done; null keys are new each time."""
        same = [items[k] == F.col(f"_done.{k}") for k in self.keys]
        return items.join(self.spark.table(self.name).alias("_done"), reduce(Column.__and__, same), "left_anti")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def run(self, items: DataFrame, batch: int, work: Callable[[DataFrame], DataFrame]) -> None:
        """Applies ``work`` to the new items and writes what it returns, which has the keys, as the results of ``batch``; then its keys are done.

        Three steps, each with its marker: results, keys set aside, keys added. A batch that was killed between two of them goes on
        from there, and adds nothing twice.
        """
        results, aside, done = (f"{self.path}/{part}/batch={batch}" for part in ("results", "keys", "added"))
        if self._exists(f"{done}/_SUCCESS"):
            return
        if not self._exists(f"{results}/_SUCCESS"):
            work(self.new(items)).write.mode("overwrite").parquet(results)
        if not self._exists(f"{aside}/_SUCCESS"):
            self.spark.read.parquet(results).select(*self.keys).distinct().write.mode("overwrite").parquet(aside)
        # keys that a killed run did add are no longer new
        self.new(self.spark.read.parquet(aside)).repartition(self.buckets, *self.keys).write.insertInto(self.name)
        self.spark.range(0).write.mode("overwrite").parquet(done)

    def results(self) -> DataFrame:
        """All results, with their batch."""
        return self.spark.read.parquet(f"{self.path}/results")
