"""Readers of splits, side files, alignments, transcripts, handles and audio, all through Spark's own file sources."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import signals
from tracemill.functions.paths import ACCENTS, stem
from tracemill.functions.text import strip

#: The speaker's fields of a prepared split.
SPEAKER = "struct<age:string,comments:string,dialect_region:string,education:string,ethnicity:string,gender:string,height:string,id:string,nationality:string,native_language:string,race:string,weight:string>"
PREPARED = f"audio_path string, transcript string, duration double, dataset string, speaker_id string, prompts array<string>, responses array<string>, speaker {SPEAKER}"


def json_array(spark: SparkSession, path: str, schema: str = PREPARED, split: str | None = None) -> DataFrame:
    """The entries of files that each hold a JSON array; a missing file is an error. ``split`` becomes a column."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df if split is None else df.withColumn("split", F.lit(split))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def name_glob(extensions: tuple[str, ...]) -> str:
    """A glob of file names with one of the extensions in either case."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(map(either, extensions)) + "}"


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("wav",), content: bool = False) -> DataFrame:
    """(path, length, and with ``content`` the bytes) of all files below ``path`` with one of the extensions in either case; no
    other file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob(extensions)).load(path)
    return df.select("path", "length", *(["content"] if content else []))


def whole_texts(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, text) of whole files, for side files that are small."""
    return files(spark, path, extensions, content=True).select("path", F.decode("content", "UTF-8").alias("text"))


def numbered_lines(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, line_no, line), numbered from 1 within each file, blank lines included.

    Large files are read in splits: lines are numbered within each split, and only the splits' numbers of lines meet.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob(extensions)).text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    sizes = lines.groupBy("path", "_at").agg(F.count("*").alias("_n"))
    before = sizes.select("path", "_at", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("path", "_at").orderBy("_id"))
    return lines.withColumn("_inside", inside).join(before, ["path", "_at"]).select("path", (F.col("_before") + F.col("_inside")).cast("int").alias("line_no"), "line")


def feature_map(text: Column, digits: int | None = None) -> Column:
    """The map of numbers in a side file; empty if the file or any value of it can't be read."""
    raw = F.from_json(text, "map<string,string>")
    values = F.transform_values(raw, lambda k, v: v.try_cast("double"))
    bad = raw.isNull() | F.exists(F.map_values(values), lambda v: v.isNull())
    empty = F.create_map().cast("map<string,double>")
    return F.when(bad, empty).otherwise(F.transform_values(values, lambda k, v: F.round(v, digits)) if digits is not None else values)


def feature_files(spark: SparkSession, path: str, digits: int | None = None) -> DataFrame:
    """(path, stem, values) of .AF files."""
    return whole_texts(spark, path, ("af",)).select("path", stem(F.col("path")).alias("stem"), feature_map(F.col("text"), digits).alias("values"))


_name = re.compile(r'name\s*=\s*"(.*)"')
_mark = re.compile(r'(xmin|xmax|text)\s*=\s*(?:"(.*)"|(\S+))')


def short_tiers(lines: list[str]) -> list[tuple[str, list[tuple[float, float, str]]]]:
    """The interval tiers of a TextGrid in its short format, which has a value on each line: class, name, two times, a number of
    intervals, and two times and a mark for each. A tier that breaks off ends with its last whole interval."""
    found: list[tuple[str, list[tuple[float, float, str]]]] = []
    for i, line in enumerate(lines):
        if line != '"IntervalTier"' or i + 4 >= len(lines):
            continue
        spans: list[tuple[float, float, str]] = []
        try:
            for k in range(i + 5, i + 5 + 3 * int(lines[i + 4]), 3):
                spans.append((float(lines[k]), float(lines[k + 1]), lines[k + 2].strip('"').strip()))
        except (ValueError, IndexError):
            pass
        found.append((lines[i + 1].strip('"').strip(), spans))
    return found


def tiers(text: str) -> list[tuple[str, list[tuple[float, float, str]]]]:
    """The tiers of a TextGrid in its long or short format: name, and (start, end, mark) in seconds; what isn't whole is left out."""
    if '"IntervalTier"' in text and not _name.search(text):
        return short_tiers([line.strip() for line in text.splitlines() if line.strip()])
    found: list[tuple[str, list[tuple[float, float, str]]]] = []
    now: dict[str, str] = {}
    for line in text.splitlines():
        if m := _name.search(line):
            found.append((m[1].strip(), []))
            now = {}
        elif found and (m := _mark.search(line)):
            now[m[1]] = m[2] if m[2] is not None else m[3]
            if m[1] == "text" and "xmin" in now and "xmax" in now:
                try:
                    found[-1][1].append((float(now["xmin"]), float(now["xmax"]), now["text"].strip()))
                except ValueError:
                    pass
                now = {}
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("phoneme", T.StringType()), T.StructField("duration", T.DoubleType())])))
def textgrid_phones(texts: pd.Series) -> pd.Series:
    """The phones of the first tier whose name holds "phone", silences included; an empty array without such a tier."""
    pick = lambda t: next((x for name, x in tiers(t or "") if "phone" in name.lower()), [])
    return texts.map(lambda t: [{"phoneme": m, "duration": b - a} for a, b, m in pick(t)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("label", T.StringType())])))
def textgrid_intervals(texts: pd.Series) -> pd.Series:
    """The marked intervals of the tier named phones, in milliseconds; null without any."""
    pick = lambda t: [(a, b, m) for name, x in tiers(t or "") if name.lower() == "phones" for a, b, m in x if m]
    return texts.map(lambda t: [{"start_ms": a * 1000.0, "end_ms": b * 1000.0, "label": m} for a, b, m in pick(t)] or None)


def phone_marks(lines: DataFrame) -> DataFrame:
    """(file, seq, start_ms, label) of the lines of .phones files that start with a number: seconds first, the label last."""
    parts = F.split(strip(F.col("line")), r"\s+")
    label = F.btrim(F.btrim(F.element_at(parts, -1), F.lit(";*")), F.lit("{}"))
    rows = lines.filter(strip(F.col("line")).rlike(r"^[0-9]")).select(F.col("path").alias("file"), F.col("line_no").alias("seq"), (parts[0].try_cast("double") * 1000).alias("start_ms"), label.alias("label"))
    return rows.filter(F.col("start_ms").isNotNull())


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, start_ms, end_ms, label) of .phones and TextGrid files; a file of intervals without any is left out."""
    from tracemill.operators.intervals import starts_to_intervals

    marks = starts_to_intervals(phone_marks(numbered_lines(spark, path, ("phones",))))
    grids = whole_texts(spark, path, ("textgrid",)).select(F.col("path").alias("file"), F.posexplode(textgrid_intervals("text")).alias("seq", "x")).select("file", "seq", "x.*")
    cols = ["file", "seq", "start_ms", "end_ms", "label"]
    return marks.select(*cols).unionByName(grids.select(*cols))


def alignment_format(path: Column) -> Column:
    """phones or textgrid by the suffix; anything else is an error."""
    low = F.lower(path)
    return F.when(low.endswith(".phones"), "phones").when(low.endswith(".textgrid"), "textgrid").otherwise(F.raise_error(F.concat(F.lit("unknown alignment format: "), path)).cast("string"))


def id_and_text(line: Column) -> Column:
    """(utt_id, text) of a line, parted by the first white space; the text may be empty."""
    parts = F.split(strip(line), r"\s+", 2)
    return F.struct(parts[0].alias("utt_id"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("text"))


def tabbed_transcript(line: Column) -> Column:
    """(utt_id, text) of a line, parted by the first tab if there is one, else by white space; null for a single word."""
    parts = F.when(line.contains("\t"), F.split(line, "\t", 2)).otherwise(F.split(strip(line), r"\s+", 2))
    return F.when(F.size(parts) == 2, F.struct(strip(parts[0]).alias("utt_id"), strip(parts[1]).alias("text")))


def first_line_text(text: Column) -> Column:
    """The third part of the first line of a .TXT file, which starts with two sample numbers; the whole line without them."""
    line = strip(F.split(text, r"\r?\n")[0])
    return F.coalesce(F.try_element_at(F.split(line, " ", 3), F.lit(3)), line)


def trans_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, utt_id, text) of .trans.txt files, without blank lines."""
    lines = numbered_lines(spark, path, ("txt",)).filter(F.lower("path").endswith(".trans.txt") & (strip(F.col("line")) != ""))
    return lines.select("path", id_and_text(F.col("line")).alias("x")).select("path", "x.*")


def transcript_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(line_no, utt_id, text, status) of transcripts.txt; blank lines count for ``limit`` and in the numbers; ERROR marks a line of one word."""
    lines = numbered_lines(spark, path, ("txt",))
    if limit:
        lines = lines.filter(F.col("line_no") <= limit)
    rows = lines.withColumn("x", tabbed_transcript(F.col("line")))
    return rows.select("line_no", "x.*", F.when(strip(F.col("line")) == "", "BLANK").when(F.col("x").isNull(), "ERROR").otherwise("OK").alias("status"))


def handles(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(handle): stripped lines, without blank ones and comments; the first ``limit`` of the file, 0 means all."""
    rows = numbered_lines(spark, path, ("txt", "list", "lst")) if limit else spark.read.text(path).withColumnRenamed("value", "line")
    rows = rows.withColumn("handle", strip(F.col("line"))).filter((F.col("handle") != "") & ~F.col("handle").startswith("#"))
    return (rows.orderBy("path", "line_no").limit(limit) if limit else rows).select("handle")


def first_path_of_stem(paths: DataFrame, path: str = "path") -> DataFrame:
    """(utt_id, path): the first path of each stem."""
    return paths.groupBy(stem(F.col(path)).alias("utt_id")).agg(F.min(path).alias(path))


def native_languages(spark: SparkSession, path: str) -> DataFrame:
    """(speaker_id, native_language) of a JSON object that maps speakers to their data."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<`native language`:string>>")).alias("speaker_id", "x"))
    return raw.select("speaker_id", F.coalesce(F.col("x")["native language"], F.lit("")).alias("native_language"))


def stats(spark: SparkSession, path: str) -> DataFrame:
    """The fitted quantiles as write_stats() left them: one row, as latents.fit_row() gives it."""
    return spark.read.json(path)


def sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketches as write_sketches() left them."""
    return spark.read.parquet(path)


def speaker_accents(table: DataFrame, speaker: str = "id", nationality: str = "nationality") -> DataFrame:
    """(speaker_id, accent) of a table of speakers whose columns are found by their names in any case; nationalities that
    ACCENTS lacks have the empty accent."""
    named = {c.lower().strip(): c for c in table.columns}
    pick = lambda part: next(c for low, c in named.items() if part in low)
    accent = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACCENTS.items() for x in kv]), strip(F.col(f"`{pick(nationality)}`"))), F.lit(""))
    return table.select(strip(F.col(f"`{pick(speaker)}`")).alias("speaker_id"), accent.alias("accent"))


def pcm(raw: bytes, width: int) -> np.ndarray:
    """PCM samples of 1 to 4 bytes, from -1 to 1; those of one byte are unsigned."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8) - 128.0) / 128
    whole = np.zeros((len(raw) // width, 4), np.uint8)
    whole[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return whole.view("<i4").ravel() / 2147483648.0


#: Frames of a file that are decoded together.
BLOCK = 1 << 16


def decode_wav(content: bytes, rate: int = 16000) -> np.ndarray | None:
    """The samples of PCM as one channel at ``rate``, from -1 to 1; None for anything else. Decoded in blocks, each of which goes through
    a band-limited filter that keeps only its own length of past samples."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            own, parts = w.getframerate(), []
            other = signals.Resampler(own, rate) if own != rate else None
            while raw := w.readframes(BLOCK):
                x = pcm(raw, w.getsampwidth()).reshape(-1, w.getnchannels()).mean(1)
                parts.append(other.feed(x) if other else x)
            if other:
                parts.append(other.end())
            return np.concatenate([np.zeros(0), *parts])
    except (wave.Error, EOFError, ValueError, ZeroDivisionError):
        return None


def audio(spark: SparkSession, path: str, rate: int = 16000, extensions: Sequence[str] = ("wav",), decode: Callable[[bytes, int], np.ndarray | None] = decode_wav) -> DataFrame:
    """(path, samples): decoded audio; null samples for files that can't be decoded. ``decode`` takes a file's bytes and the rate, for
    formats other than PCM."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "samples": [decode(c, rate) for c in f["content"]]})

    return files(spark, path, tuple(extensions), content=True).select("path", "content").mapInPandas(run, "path string, samples array<double>")


def line_limit(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The first ``n`` lines of each file, blank ones included."""
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(order))).filter(F.col("_n") <= n).drop("_n")
