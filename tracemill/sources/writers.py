"""Writers: appended results, one text file for each utterance, an audit log, audio, copies of files."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracemill.operators.held import held


def append_json(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Rows as JSON lines beside those that are there, non-ASCII as it is; nothing is written anew."""
    w = rows.write.mode("append")
    (w.partitionBy(partition) if partition else w).json(path)


def append_parquet(rows: DataFrame, path: str, *partition: str) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_features(features: DataFrame, path: str, key: str = "path") -> None:
    """One table of features by path instead of a side file for each recording."""
    features.select(key, "values").write.mode("overwrite").parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """The fitted quantiles, a row for each scalar."""
    stats.write.mode("overwrite").json(path)


def write_sketches(sketches: DataFrame, path: str) -> None:
    """The sketches of a run, to be read by readers.sketches() and merged with those of later ones."""
    sketches.write.mode("overwrite").parquet(path)


def write_observed(rows: DataFrame, path: str, **measures: Column) -> dict[str, object]:
    """Writes ``rows`` as Parquet and gives the aggregates ``measures`` of them, taken while they are written: no second job."""
    seen = Observation()
    rows.observe(seen, *[c.alias(name) for name, c in measures.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content", overwrite: bool = False) -> DataFrame:
    """(name, status): each row's content (bytes, or text in UTF-8) as a file of its own below ``folder``, which all executors share.

    status is CREATED, or SKIPPED for a file that is there and is left; with ``overwrite`` it is replaced. Files are made in tasks,
    under another name first, so that a lost task leaves no half of one. The result is written to the shared folder.
    """
    root = folder if "://" in folder else f"file://{folder}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [put(c.encode() if isinstance(c, str) else bytes(c), f"{root}/{n}", overwrite) for n, c in zip(f["name"], f["content"])]
            yield pd.DataFrame({"name": f["name"], "status": ["CREATED" if d else "SKIPPED" for d in done]})

    asked = rows.select(F.col(name).alias("name"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    return held(asked.mapInPandas(run, "name string, status string"), "files")


def put(content: bytes, dest: str, overwrite: bool = False) -> bool:
    """Writes a file unless there is one at ``dest``, and says whether it did."""
    there, path = located(dest)
    if not overwrite and there.get_file_info(path).type != fs.FileType.NotFound:
        return False
    folder, name = path.rsplit("/", 1)
    there.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with there.open_output_stream(part) as w:
        w.write(content)
    there.move(part, path)
    return True


def write_utterances(rows: DataFrame, folder: str, utt_id: str = "utt_id", text: str = "text", suffix: str = ".lab", overwrite: bool = False) -> DataFrame:
    """(name, status): the text of each utterance and a line end in a file of its own, as aligners want them. Of several rows of
    an utterance the smallest text is written."""
    one = rows.groupBy(F.concat(F.col(utt_id), F.lit(suffix)).alias("name")).agg(F.concat(F.coalesce(F.min(text), F.lit("")), F.lit("\n")).alias("content"))
    return write_files(one, folder, overwrite=overwrite)


def write_wavs(audio: DataFrame, folder: str, path: str = "path", rate: int = 16000) -> DataFrame:
    """(name, status): the samples of each recording (path, samples) as a 16-bit wav file at ``path`` below ``folder``."""
    return write_files(encoded(audio.withColumnRenamed(path, "path"), rate), folder, name="path")


def append_log(rows: DataFrame, path: str, columns: tuple[str, ...] = ("status", "source", "dest")) -> None:
    """timestamp and ``columns`` as tab-separated lines with a header, beside those that are there."""
    stamped = rows.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), *columns)
    stamped.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def encode_wav(samples: np.ndarray, rate: int = 16000) -> bytes:
    """16-bit PCM, one channel."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1 - 1 / 32768) * 32768).round().astype("<i2").tobytes())
    return out.getvalue()


def encoded(audio: DataFrame, rate: int = 16000) -> DataFrame:
    """(path, content) of (path, samples): wav files as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [encode_wav(x, rate) for x in f["samples"]]})

    return audio.filter(F.col("samples").isNotNull()).select("path", "samples").mapInPandas(run, "path string, content binary")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, whose path may hold any characters, and the path there."""
    scheme, _, rest = uri.partition(":/")
    # Spark shows local files with one slash after the scheme or with three
    return fs.FileSystem.from_uri(f"file:///{quote(rest.lstrip('/'))}" if scheme == "file" else f"{scheme}:/{quote(rest)}")


def copy_one(source: str, dest: str, piece: int = 1 << 20) -> bool:
    """Copies a file unless there is one at ``dest``, and says whether it did. The copy is made under a name of its own and
    then moved, so that a lost task leaves no half of a file at ``dest``."""
    there, path = located(dest)
    if there.get_file_info(path).type != fs.FileType.NotFound:
        return False
    here, origin = located(source)
    folder, name = path.rsplit("/", 1)
    there.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with here.open_input_stream(origin) as r, there.open_output_stream(part) as w:
        while got := r.read(piece):
            w.write(got)
    there.move(part, path)
    return True


def copy_files(plan: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Carries out a copy_plan() under ``folder``, which all executors share, and returns its rows with what came of each.

    Only rows with the status COPY are copied, dealt by handle over ``tasks`` tasks; a file that has come there since is left
    and its row says EXISTS, 1. So does a row whose task is run again after its copy. Other rows stay as they are. The result
    is written to the shared folder, so that reading it twice copies nothing.
    """
    root = folder if "://" in folder else f"file://{folder}"
    columns = plan.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f.index[f["status"] == "COPY"]:
                source = f.at[i, "source"]
                if not copy_one(source if ":/" in source else f"file://{source}", f"{root}/{f.at[i, 'dest']}"):
                    f.at[i, "status"], f.at[i, "code"] = "EXISTS", 1
            yield f[columns]

    dealt = plan.repartition(*([tasks] if tasks else []), "handle")
    return held(dealt.mapInPandas(run, plan.schema), "copies")
