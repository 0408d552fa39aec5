"""Tables that are written once to the folder that all executors share and then read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder, a cluster without it an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_held_dir"):
        spark.sparkContext._held_dir = "file://" + tempfile.mkdtemp(prefix="held-")
    return spark.sparkContext._held_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/held/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when it has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def held(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df``, computed once, written as Parquet and read back: later jobs neither recompute it nor lose it with an executor, and what
    is not determined by the data, such as a partition's number, is the same in every later use.

    Its shuffle files go when it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path, was = new_path(spark, name), spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_TIDY, was) if was else spark.conf.unset(_TIDY)
    found = spark.read.schema(df.schema).parquet(path)
    found.held_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that held() wrote and that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.held_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
