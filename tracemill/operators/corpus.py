"""Corpora and their side files: joins with a status, preferences, schema alignment, run summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import paths

#: The columns that every corpus has, in order.
META = ("filename", "speaker_id", "dataset", "file_path", "dialect_code", "dialect", "split", "emotion", "speech_type", "accent", "native_language")
#: Fixed value: slices of fewer samples are dropped.
LEAST_SAMPLES = 1600


def align_schema(df: DataFrame, meta: Sequence[str] = META) -> DataFrame:
    """``meta`` first, empty texts where ``df`` lacks them, then the other columns in order."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in meta], *[c for c in df.columns if c not in meta])


def union_corpora(frames: Sequence[DataFrame], meta: Sequence[str] = META) -> DataFrame:
    """All rows of all corpora in one schema; columns that one lacks are null there."""
    out = align_schema(frames[0], meta)
    for f in frames[1:]:
        out = out.unionByName(align_schema(f, meta), allowMissingColumns=True)
    return out


def describe_files(files: DataFrame, dataset: str, parse: Callable[[Column], Mapping[str, Column]], path: str = "file_path") -> DataFrame:
    """``files`` with filename, dataset and the columns that ``parse`` takes from the path."""
    return files.withColumns({"filename": paths.file_name(F.col(path)), "dataset": F.lit(dataset), **parse(F.col(path))})


def timit_fields(path: Column) -> dict[str, Column]:
    d = paths.dialect_path(path)
    return {c: d[c] for c in ("speaker_id", "dialect_code", "dialect", "split")}


def ears_fields(path: Column) -> dict[str, Column]:
    e = paths.emotion_name(paths.file_name(path))
    return {"speaker_id": paths.parent(path), "emotion": e["emotion"], "speech_type": e["speech_type"]}


def add_language(files: DataFrame, speakers: DataFrame, speaker: str = "speaker_id", language: str = "native_language") -> DataFrame:
    """``files`` with their speaker's native language, empty for speakers that the dimension lacks or repeats without one."""
    one = speakers.groupBy(speaker).agg(F.max(language).alias(language))
    return files.drop(language).join(one, speaker, "left").withColumn(language, F.coalesce(language, F.lit("")))


def attach(audio: DataFrame, side: DataFrame, key: str, column: str, empty: Column) -> DataFrame:
    """``audio`` with ``column`` of its side file, ``empty`` if it has none; of several side files of a key the last path counts."""
    one = side.groupBy(key).agg(F.max_by(column, "path").alias(column)) if "path" in side.columns else side.select(key, column)
    return audio.join(one, key, "left").withColumn(column, F.coalesce(F.col(column), empty))


def attach_mirrored(audio: DataFrame, side: DataFrame, audio_root: str, side_root: str, column: str, empty: Column, path: str = "path") -> DataFrame:
    """``audio`` with ``column`` of the side file at the same relative path below ``side_root``, whatever its extension."""
    key = lambda root: paths.with_suffix(paths.relative(F.col(path), root), "")
    return attach(audio.withColumn("_mirror", key(audio_root)), side.select(path, key(side_root).alias("_mirror"), column), "_mirror", column, empty).drop("_mirror")


def new_entries(entries: DataFrame, done: DataFrame, key: str = "audio_path", once: bool = True) -> DataFrame:
    """The entries whose key isn't done; with ``once`` also one of each key among them, as the corpus of emotions has it."""
    left = entries.join(done.select(key).distinct(), key, "left_anti")
    return left.dropDuplicates([key]) if once else left


def files_by_speaker(files: DataFrame, speaker: str = "speaker_id", *distinct: str) -> DataFrame:
    """(speaker, n, n_<column> for each of ``distinct``): how many files a speaker has, and how many different values."""
    return files.groupBy(speaker).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct])


def by_language(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """All corpora as one, with the language that each is named by."""
    out = None
    for language, rows in corpora.items():
        part = rows.withColumn("language", F.lit(language))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def common_stems(gold: DataFrame, hyp: DataFrame, stem: str = "stem", path: str = "path", rank: str = "rank") -> DataFrame:
    """(stem, gold, hyp): the stems of both sides with the path of the highest rank of each."""
    last = lambda df, name: df.groupBy(stem).agg(F.max_by(path, F.struct(rank, path)).alias(name))
    return last(gold, "gold").join(last(hyp, "hyp"), stem)


def by_preference(wanted: DataFrame, files: DataFrame, order: Sequence[str], key: str = "stem", ext: str = "ext", path: str = "path") -> DataFrame:
    """``wanted`` with the path of the first extension in ``order`` that ``files`` has for its key; null if it has none."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.lower(ext))
    best = files.withColumn("_rank", rank).filter(F.col("_rank") > 0).groupBy(key).agg(F.min_by(path, F.struct("_rank", path)).alias(path))
    return wanted.join(best, key, "left")


def transcript_status(transcripts: DataFrame, index: DataFrame, existing: DataFrame | None = None, key: str = "utt_id", skip_existing: bool = True) -> DataFrame:
    """``transcripts`` with status: MISSING (no such utterance), SKIP (it is there and is left), EXISTS (it is there), WRITE."""
    found = index.select(key).distinct().withColumn("_found", F.lit(True))
    out = transcripts.join(found, key, "left")
    if existing is not None:
        out = out.join(existing.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    there = F.col("_there").isNotNull() if existing is not None else F.lit(False)
    status = F.when(F.col("_found").isNull(), "MISSING").when(there, "SKIP" if skip_existing else "EXISTS").otherwise("WRITE")
    return out.withColumn("status", status).drop("_found", "_there")


def run_summary(rows: DataFrame, status: str = "status", values: Sequence[str] = ("WRITE", "EXISTS", "SKIP", "MISSING")) -> DataFrame:
    """One row: total and how many rows have each status."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v.lower()) for v in values])


def prepared_slices(rows: DataFrame, samples: str = "samples", start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Rows with their samples cut to start and end, without short slices and without those of which nothing was heard."""
    cut = rows.withColumn(samples, paths.clamp_slice(F.col(samples), F.col(start), F.col(end)))
    return cut.filter((F.size(samples) >= LEAST_SAMPLES) & (F.coalesce(text, F.lit("")) != "")).withColumn("duration", F.size(samples) / 16000.0)


def to_be_extracted(files: DataFrame, features: DataFrame, key: str = "path", needed: Sequence[str] = ("jitter_local", "shimmer_local")) -> DataFrame:
    """The files without a feature row that has all of ``needed``."""
    whole = features
    for c in needed:
        whole = whole.filter(F.col("values")[c].isNotNull())
    return files.join(whole.select(key).distinct(), key, "left_anti")


def copy_plan(handles: DataFrame, audio: DataFrame, there: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """(handle, source, dest, status, code) for each handle: MISSING 2, EXISTS 1, DRY-RUN or COPY 0; nothing there is overwritten."""
    met = by_preference(handles.withColumnRenamed("handle", "stem"), audio, ("flac", "wav", "mp3")).withColumnRenamed("path", "source").withColumnRenamed("stem", "handle")
    dest = F.concat_ws("/", paths.handle_folder(F.col("handle")), paths.file_name(F.col("source")))
    out = met.withColumn("dest", F.when(paths.handle_parts(F.col("handle")).isNotNull() & F.col("source").isNotNull(), dest))
    there = F.array_contains(F.lit(None).cast("array<string>"), F.col("dest")) if there is None else F.col("_there").isNotNull()
    return out.withColumn("status", F.when(F.col("dest").isNull(), "MISSING").when(F.coalesce(there, F.lit(False)), "EXISTS").otherwise("DRY-RUN" if dry_run else "COPY")).withColumn("code", F.when(F.col("status") == "MISSING", 2).when(F.col("status") == "EXISTS", 1).otherwise(0))
