"""File queries: tables are written as the files that a run meets, each to a new shared folder, and read back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import paths, phonology
from tracemill.operators import corpus, generation, latents, quantiles, training
from tracemill.operators.held import held, new_path
from tracemill.plans.registry import query, table
from tracemill.sources import readers, writers


def named(rows: DataFrame, name: Column, content: Column) -> DataFrame:
    return rows.select(name.alias("name"), content.alias("content"))


def written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A new folder with a file for each row (name, content)."""
    folder = new_path(spark, name)
    writers.write_files(rows, folder).count()
    return folder


def text_key(c: str) -> Column:
    return F.col(c).cast("string")


_SPLIT = "SELECT n_name AS audio_path, 'says ' || n_name AS transcript, n_nationkey * 1.5 AS duration, r_name AS speaker_id, 'train' AS split FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("json_array_scan", _SPLIT)
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a JSON array for each region, read as a split."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.col("n_name").alias("audio_path"), F.concat(F.lit("says "), F.col("n_name")).alias("transcript"), (F.col("n_nationkey") * 1.5).alias("duration"), F.struct(F.col("r_name").alias("id")).alias("speaker"))
    files = rows.groupBy("r_name").agg(F.to_json(F.collect_list(entry)).alias("content"))
    folder = written(spark, named(files, F.concat("r_name", F.lit(".json")), F.col("content")), "split")
    return readers.json_array(spark, folder, split="train").select("audio_path", "transcript", "duration", F.col("speaker.id").alias("speaker_id"), "split")


@query("json_lines_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_custkey % 3 AS part FROM customer")
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended in three goes, in one folder."""
    rows, folder = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 3).alias("part")), new_path(spark, "results")
    for k in range(3):
        writers.append_json(rows.filter(F.col("part") == k), folder)
    return readers.json_lines(spark, folder, "c_custkey long, c_name string, c_acctbal double, part long")


@query("csv_roundtrip", "SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS label, p_retailprice FROM part")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with commas and quotes."""
    rows, folder = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"), "p_retailprice"), new_path(spark, "csv")
    writers.write_csv(rows, folder)
    return readers.csv_table(spark, folder, "p_partkey long, label string, p_retailprice double")


def feature_folder(spark: SparkSession, sf_dir: str) -> str:
    """A side file of features for each supplier, below a folder for each nation; those of nation 3 can't be read."""
    values = F.to_json(F.create_map(F.lit("pitch_mean"), F.col("s_acctbal"), F.lit("F1_mean"), F.col("s_suppkey") * 1.25))
    content = F.when(F.col("s_nationkey") == 3, F.lit("{broken")).otherwise(values)
    return written(spark, named(table(spark, sf_dir, "supplier"), F.concat(text_key("s_nationkey"), F.lit("/"), "s_suppkey", F.lit(".AF")), content), "features")


_VALUES = "CASE WHEN s_nationkey = 3 THEN NULL ELSE {} END"


@query("feature_files_scan", f"SELECT s_suppkey::VARCHAR AS stem, {_VALUES.format('round(s_acctbal::DECIMAL(18, 2), 1)::DOUBLE')} AS pitch_mean, {_VALUES.format('round((s_suppkey * 1.25)::DECIMAL(18, 2), 1)::DOUBLE')} AS f1_mean FROM supplier")
def feature_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.feature_files(spark, feature_folder(spark, sf_dir), digits=1)
    return found.select("stem", F.try_element_at("values", F.lit("pitch_mean")).alias("pitch_mean"), F.try_element_at("values", F.lit("F1_mean")).alias("f1_mean"))


@query("features_sink", f"SELECT s_suppkey::VARCHAR AS stem, {_VALUES.format('s_acctbal')} AS pitch_mean FROM supplier")
def features_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of all side files instead of a file each."""
    folder = new_path(spark, "features-table")
    writers.write_features(readers.feature_files(spark, feature_folder(spark, sf_dir)), folder, key="stem")
    return spark.read.parquet(folder).select("stem", F.try_element_at("values", F.lit("pitch_mean")).alias("pitch_mean"))


@query("mirrored_features", f"SELECT s_suppkey, {_VALUES.format('s_acctbal')} AS pitch_mean, s_suppkey % 2 = 0 AS same_tree FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, NULL, false FROM supplier WHERE s_suppkey % 2 > 0")
def mirrored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side files at the mirrored path; every other recording lies elsewhere and has none."""
    folder = feature_folder(spark, sf_dir)
    tree = F.when(F.col("s_suppkey") % 2 == 0, text_key("s_nationkey")).otherwise("elsewhere")
    audio = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("same_tree"), F.concat(F.lit("/audio/"), tree, F.lit("/"), "s_suppkey", F.lit(".wav")).alias("path"))
    found = corpus.attach_mirrored(audio, readers.feature_files(spark, folder), "/audio", folder, "values", F.create_map().cast("map<string,double>"))
    return found.select("s_suppkey", F.try_element_at("values", F.lit("pitch_mean")).alias("pitch_mean"), "same_tree")


@query("attach_features", f"SELECT s_suppkey, coalesce({_VALUES.format('s_acctbal')}, -1) AS pitch_mean FROM supplier")
def attach_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = table(spark, sf_dir, "supplier").select("s_suppkey", text_key("s_suppkey").alias("stem"))
    found = corpus.attach(audio, readers.feature_files(spark, feature_folder(spark, sf_dir)), "stem", "values", F.create_map().cast("map<string,double>"))
    return found.select("s_suppkey", F.coalesce(F.try_element_at("values", F.lit("pitch_mean")), F.lit(-1.0)).alias("pitch_mean"))


@query("to_be_extracted", "SELECT s_suppkey::VARCHAR AS stem FROM supplier WHERE s_nationkey = 3 OR s_acctbal IS NULL")
def to_be_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select(text_key("s_suppkey").alias("stem"))
    return corpus.to_be_extracted(files, readers.feature_files(spark, feature_folder(spark, sf_dir)), "stem", ("pitch_mean", "F1_mean"))


def grid_folder(spark: SparkSession, sf_dir: str) -> str:
    """For each nation a TextGrid with a tier of words and one of phones, the second phone without a mark, and a .phones file."""
    n = F.col("n_nationkey")
    span = lambda a, b, mark: F.format_string('xmin = %s\nxmax = %s\ntext = "%s"\n', *[x.cast("string") for x in (a, b)], mark)
    zero, half = F.lit(0.0), F.lit(0.5)
    last = half + (n + 1) * 0.25
    grid = F.concat(F.lit('item [1]:\nname = "words"\n'), span(zero, last, F.col("n_name")), F.lit('item [2]:\nname = "phones"\n'), span(zero, F.lit(0.25), F.lit("a")), span(F.lit(0.25), half, F.lit("")), span(half, last, F.lit("b")))
    marks = F.concat(F.lit("header\n0.0  122 SIL\n0.5  122 aa;*\n"), last.cast("string"), F.lit("  122 {B_TRANS}\n"))
    rows = table(spark, sf_dir, "nation")
    folder = written(spark, named(rows, F.concat("n_name", F.lit(".TextGrid")), grid), "grids")
    writers.write_files(named(rows, F.concat("n_name", F.lit(".phones")), marks), folder).count()
    writers.write_files(named(rows, F.concat("n_name", F.lit(".txt")), F.lit("no alignment")), folder).count()
    return folder


_LAST = "0.5 + (n_nationkey + 1) * 0.25"


@query("textgrid_phones_scan", f"SELECT n_name AS stem, 3 AS n, 'a,,b' AS phones, {_LAST} AS seconds FROM nation")
def textgrid_phones_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = readers.whole_texts(spark, grid_folder(spark, sf_dir), ("textgrid",)).select(paths.stem(F.col("path")).alias("stem"), readers.textgrid_phones("text").alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["duration"])
    return grids.select("stem", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["phoneme"]), ",").alias("phones"), total.alias("seconds"))


@query(
    "alignments_scan",
    f"SELECT n_name AS stem, 'textgrid' AS format, 0.0 AS start_ms, 250.0 AS end_ms, 'a' AS label FROM nation UNION ALL SELECT n_name, 'textgrid', 500.0, ({_LAST}) * 1000, 'b' FROM nation "
    f"UNION ALL SELECT n_name, 'phones', 0.0, 500.0, 'SIL' FROM nation UNION ALL SELECT n_name, 'phones', 500.0, ({_LAST}) * 1000, 'aa' FROM nation",
)
def alignments_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both formats of alignments in one folder; the last mark of a .phones file has no end and goes."""
    found = readers.alignments(spark, grid_folder(spark, sf_dir))
    return found.select(paths.stem(F.col("file")).alias("stem"), readers.alignment_format(F.col("file")).alias("format"), "start_ms", "end_ms", "label")


def line_folder(spark: SparkSession, sf_dir: str, line: Column, name: Column, order: str, suffix: str) -> str:
    """The rows of customers as lines of a file for each nation."""
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return written(spark, named(files, F.concat(name, F.lit(suffix)), F.concat("content", F.lit("\n"))), "lines")


@query("trans_files_scan", "SELECT c_nationkey::VARCHAR AS book, c_custkey::VARCHAR AS utt_id, CASE WHEN c_custkey % 5 > 0 THEN c_name || '  says' ELSE '' END AS text FROM customer")
def trans_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an id and a text that may be missing, and blank lines."""
    said = F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("  "), "c_name", F.lit("  says"))).otherwise("")
    line = F.concat("c_custkey", said, F.when(F.col("c_custkey") % 7 == 0, "\n").otherwise(""))
    folder = line_folder(spark, sf_dir, line, text_key("c_nationkey"), "c_custkey", ".trans.txt")
    writers.write_files(named(table(spark, sf_dir, "region"), F.concat("r_name", F.lit(".txt")), F.lit("not a transcript")), folder).count()
    return readers.trans_files(spark, folder).select(F.regexp_extract("path", r"([0-9]+)\.trans\.txt$", 1).alias("book"), "utt_id", "text")


_TABBED = "CASE WHEN c_custkey % 4 = 0 THEN 'lone' || c_custkey WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN c_custkey || chr(9) || c_name || ' b' ELSE c_custkey || ' ' || c_name END"
_STATUS = "CASE c_custkey % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'BLANK' ELSE 'OK' END"
_TRANSCRIPTS = f"SELECT c_nationkey::VARCHAR AS book, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INTEGER AS line_no, CASE WHEN c_custkey % 4 > 1 THEN c_custkey::VARCHAR END AS utt_id, CASE c_custkey % 4 WHEN 2 THEN c_name || ' b' WHEN 3 THEN c_name END AS text, {_STATUS} AS status FROM customer"


def transcript_folder(spark: SparkSession, sf_dir: str) -> str:
    return line_folder(spark, sf_dir, F.expr(_TABBED), F.concat(text_key("c_nationkey"), F.lit("/transcripts")), "c_custkey", ".txt")


@query("transcripts_scan", f"SELECT utt_id, text, status, count(*) AS n, sum(line_no)::BIGINT AS lines FROM ({_TRANSCRIPTS}) GROUP BY utt_id, text, status")
def transcripts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabbed and spaced lines, lone words and blank lines of transcripts, numbered within their files."""
    found = readers.transcript_lines(spark, transcript_folder(spark, sf_dir))
    return found.groupBy("utt_id", "text", "status").agg(F.count("*").alias("n"), F.sum("line_no").alias("lines"))


@query("line_limit", f"SELECT book, line_no, utt_id FROM ({_TRANSCRIPTS}) WHERE line_no <= 3")
def line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of each file are the feature; blank ones count."""
    lines = readers.line_limit(readers.numbered_lines(spark, transcript_folder(spark, sf_dir), ("txt",)), 3)
    return lines.select(F.regexp_extract("path", r"([0-9]+)/transcripts\.txt$", 1).alias("book"), "line_no", readers.tabbed_transcript(F.col("line"))["utt_id"].alias("utt_id"))


_HANDLE = "CASE c_custkey % 3 WHEN 0 THEN '# ' || c_custkey WHEN 1 THEN '' ELSE ' ' || c_nationkey || '_' || c_custkey || '_1 ' END"


@query("handles_scan", "SELECT c_nationkey || '_' || c_custkey || '_1' AS handle FROM customer WHERE c_custkey % 3 = 2")
def handles_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles with blanks around them, comments and blank lines."""
    return readers.handles(spark, line_folder(spark, sf_dir, F.expr(_HANDLE), text_key("c_nationkey"), "c_custkey", ".txt"))


@query("first_handles", "SELECT n_name AS handle FROM nation ORDER BY n_nationkey LIMIT 7")
def first_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven handles of a file are the feature."""
    one = table(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n# \n").alias("content"))
    return readers.handles(spark, written(spark, named(one, F.lit("handles.txt"), F.col("content")), "handles"), limit=7)


@query("first_lines_scan", "SELECT s_suppkey::VARCHAR AS stem, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' had your suit' ELSE s_name END AS text FROM supplier")
def first_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text after two sample numbers in the first line, or the line without them."""
    line = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("0 6190 "), "s_name", F.lit(" had your suit"))).otherwise(F.col("s_name"))
    folder = written(spark, named(table(spark, sf_dir, "supplier"), F.concat(text_key("s_suppkey"), F.lit(".TXT")), F.concat(line, F.lit("\r\nsecond\n"))), "first-lines")
    found = readers.whole_texts(spark, folder, ("txt",))
    return found.select(paths.stem(F.col("path")).alias("stem"), readers.first_line_text(F.col("text")).alias("text"))


def wav_folder(spark: SparkSession, sf_dir: str) -> str:
    """A wav file for each nation, of n / 32 in 160 + n samples, in either case of the extension, beside files of other kinds."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("deep/"), name, F.when(n % 2 == 0, ".wav").otherwise(".WAV")).alias("path"), F.array_repeat(n / 32, 160 + n).alias("samples"))
    folder = new_path(spark, "wavs")
    writers.write_wavs(rows, folder).count()
    writers.write_files(named(table(spark, sf_dir, "nation"), F.concat(name, F.lit(".flac")), F.lit("not read")), folder).count()
    return folder


@query("wav_roundtrip", "SELECT n_name AS stem, 160 + n_nationkey AS n, n_nationkey / 32.0 AS first, (160 + n_nationkey) / 16000.0 AS seconds FROM nation")
def wav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.audio(spark, wav_folder(spark, sf_dir))
    return found.select(paths.stem(F.col("path")).alias("stem"), F.size("samples").alias("n"), F.col("samples")[0].alias("first"), (F.size("samples") / 16000).alias("seconds"))


_TONE = "round(0.4 * sin(2 * pi() * (200 + 50 * n_nationkey) * {0} / {1}), 2)"


@query("wav_resampled", f"SELECT n_name AS stem, 8000 AS n, {_TONE.format(4001, 16000)} AS low, 24000 AS n_back, {_TONE.format(12003, 48000)} AS back FROM nation")
def wav_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones of half a second at 44,100 or 48,000 Hz beside one that 16,000 Hz can't hold, brought to 16,000 Hz, written, and brought back up to 48,000."""
    n, folder, found = F.col("n_nationkey"), new_path(spark, "tones"), []
    for own, part in ((44100, 0), (48000, 1)):
        turn = lambda hz, i, own=own: F.sin(2 * math.pi * hz * i / own)
        tone = F.transform(F.sequence(F.lit(0), F.lit(own // 2 - 1)), lambda i: 0.4 * turn(200 + 50 * n, i) + 0.4 * turn(F.lit(9500), i))
        rows = table(spark, sf_dir, "nation").filter(n % 2 == part).select(F.concat("n_name", F.lit(".wav")).alias("path"), tone.alias("samples"))
        writers.write_wavs(rows, f"{folder}/{own}", rate=own).count()
        found.append(readers.audio(spark, f"{folder}/{own}"))
    low = held(found[0].unionByName(found[1]).withColumn("path", F.concat(paths.stem(F.col("path")), F.lit(".wav"))), "low")
    writers.write_wavs(low, f"{folder}/16000").count()
    back = readers.audio(spark, f"{folder}/16000", 48000).select(paths.stem(F.col("path")).alias("stem"), F.size("samples").alias("n_back"), F.round(F.col("samples")[12003], 2).alias("back"))
    return low.select(paths.stem(F.col("path")).alias("stem"), F.size("samples").alias("n"), F.round(F.col("samples")[4001], 2).alias("low")).join(back, "stem")


@query("file_scan", "SELECT n_name AS stem, 44 + 2 * (160 + n_nationkey) AS length FROM nation UNION ALL SELECT n_name, 8 FROM nation")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two extensions at any depth, in order of their paths."""
    return readers.files(spark, wav_folder(spark, sf_dir), ("wav", "flac")).orderBy("path").select(paths.stem(F.col("path")).alias("stem"), "length")


@query("audio_base64", "SELECT n_name AS stem, 'bm90IHJlYWQ=' AS audio FROM nation")
def audio_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.files(spark, wav_folder(spark, sf_dir), ("flac",), content=True).select(paths.stem(F.col("path")).alias("stem"), F.base64("content").alias("audio"))


@query("speaker_metadata_scan", "SELECT s_suppkey::VARCHAR AS speaker_id, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE '' END AS native_language FROM supplier")
def speaker_metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object of speakers for each nation; some have no language."""
    language = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name"))
    entry = F.struct(text_key("s_suppkey").alias("key"), F.struct(language.alias("native language"), F.lit("x").alias("age")).alias("value"))
    files = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("content"))
    return readers.native_languages(spark, written(spark, named(files, F.concat("s_nationkey", F.lit(".json")), F.col("content")), "speakers"))


@query("speaker_accents", "SELECT s_suppkey::VARCHAR AS speaker_id, CASE s_suppkey % 4 WHEN 0 THEN 'american' WHEN 1 THEN 'south_african' ELSE '' END AS accent FROM supplier")
def speaker_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(text_key("s_suppkey").alias("VoxCeleb ID"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'USA' WHEN 1 THEN ' South Africa' WHEN 2 THEN 'Atlantis' END").alias("Nationality"))
    folder = new_path(spark, "accents")
    writers.write_csv(rows, folder)
    return readers.speaker_accents(readers.csv_table(spark, folder))


@query("lab_files", "SELECT s_suppkey::VARCHAR AS stem, s_name || chr(10) AS text, 'CREATED' AS first, 'SKIPPED' AS again FROM supplier")
def lab_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A .lab file for each utterance under its own name; a second run leaves them all."""
    rows, folder = table(spark, sf_dir, "supplier").select(text_key("s_suppkey").alias("utt_id"), F.col("s_name").alias("text")), new_path(spark, "labs")
    first, again = (writers.write_utterances(rows, folder).select(paths.stem(F.col("name")).alias("stem"), F.col("status").alias(c)) for c in ("first", "again"))
    found = readers.whole_texts(spark, folder, ("lab",)).select(paths.stem(F.col("path")).alias("stem"), "text")
    return found.join(first, "stem").join(again, "stem")


@query("utterance_summary", "SELECT count(*) AS total, count(*) AS created, 0::BIGINT AS skipped FROM supplier")
def utterance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(text_key("s_suppkey").alias("utt_id"), F.col("s_name").alias("text"))
    return corpus.run_summary(writers.write_utterances(rows, new_path(spark, "labs"), suffix=".txt"), values=("CREATED", "SKIPPED"))


@query("audit_log", "SELECT CASE c_custkey % 2 WHEN 0 THEN 'COPY' ELSE 'MISSING' END AS status, c_name AS source, c_mktsegment AS dest, true AS stamped FROM customer")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log, appended in two goes, each with its header."""
    rows, folder = table(spark, sf_dir, "customer").select(F.expr("CASE c_custkey % 2 WHEN 0 THEN 'COPY' ELSE 'MISSING' END").alias("status"), F.col("c_name").alias("source"), F.col("c_mktsegment").alias("dest")), new_path(spark, "log")
    for k in ("COPY", "MISSING"):
        writers.append_log(rows.filter(F.col("status") == k), folder)
    found = spark.read.option("sep", "\t").option("header", True).csv(folder)
    return found.select("status", "source", "dest", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$").alias("stamped"))


_EDGES = "SELECT quantile_cont(s_acctbal, 0.33) AS a, quantile_cont(s_acctbal, 0.66) AS b FROM supplier"


@query("stats_roundtrip", f"SELECT s_suppkey, CASE WHEN s_acctbal <= a THEN 'low' WHEN s_acctbal <= b THEN 'mid' ELSE 'high' END AS level FROM supplier, ({_EDGES})")
def stats_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles that are fitted, written, read again and applied."""
    rows, folder = table(spark, sf_dir, "supplier"), new_path(spark, "stats")
    writers.write_stats(latents.fit_row(rows, ["s_acctbal"]), folder)
    return latents.apply(rows.select("s_suppkey", "s_acctbal"), readers.stats(spark, folder), {"s_acctbal": ("low", "mid", "high")}).select("s_suppkey", F.col("s_acctbal_bin").alias("level"))


@query("merged_sketches", "SELECT round(quantile_cont(l_extendedprice, 0.33), 4) AS q33, round(quantile_cont(l_extendedprice, 0.66), 4) AS q66, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of three runs, each written when it ends; the fit of all of them reads the rows once."""
    rows, runs = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), []
    for flag in ("A", "N", "R"):
        folder = new_path(spark, "sketches")
        writers.write_sketches(latents.sketches(rows.filter(F.col("l_returnflag") == flag), ["l_extendedprice"]), folder)
        runs.append(readers.sketches(spark, folder))
    found = quantiles.merged(runs)
    return latents.fit(rows, ["l_extendedprice"], found=found).join(found.select("scalar", "n"), "scalar").select(F.round("q33", 4).alias("q33"), F.round("q66", 4).alias("q66"), "n", "min", "max")


@query("prepared_slices", "SELECT o_orderkey, least(o_orderkey % 4000 + 1000, 4000) - o_orderkey % 1000 AS n FROM orders WHERE o_orderstatus <> 'P' AND least(o_orderkey % 4000 + 1000, 4000) - o_orderkey % 1000 >= 1600")
def prepared_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of 4000 samples cut to slices whose end may lie beyond; short ones and those without a text go."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array_repeat(F.lit(0.5), 4000).alias("samples"), (F.col("o_orderkey") % 1000).alias("start"), (F.col("o_orderkey") % 4000 + 1000).alias("end"), F.when(F.col("o_orderstatus") != "P", F.lit("heard")).otherwise("").alias("text"))
    return corpus.prepared_slices(rows).select("o_orderkey", F.size("samples").cast("long").alias("n"))


@query("language_union", "SELECT 'german' AS language, c_custkey AS id, c_name AS text FROM customer UNION ALL SELECT 'polish', s_suppkey, NULL FROM supplier")
def language_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    german, polish = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    folders = {"mls_german": german, "polish_low_resource": polish}
    names = spark.createDataFrame([(k,) for k in folders], "folder string").select("folder", paths.language_of(F.col("folder")).alias("language"))
    return corpus.by_language({r.language: folders[r.folder] for r in names.collect()}).select("language", "id", "text")


@query("new_entries", "SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment || c_nationkey NOT IN (SELECT c_mktsegment || c_nationkey FROM customer WHERE c_custkey % 97 = 0)) GROUP BY c_nationkey")
def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries not done before, one of each recording in a run."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat("c_mktsegment", text_key("c_nationkey")).alias("audio_path"))
    return corpus.new_entries(rows, rows.filter("c_custkey % 97 = 0")).groupBy("c_nationkey").agg(F.count("*").alias("n"))


_ASKED = "length('user' || chr(10) || c_name || chr(10) || 'assistant' || chr(10))"
_TOLD = f"{_ASKED} + length(c_mktsegment || chr(10))"


@query("chat_examples", f"SELECT c_custkey, least(40, {_TOLD}) AS n, least(40, {_ASKED}) AS masked FROM customer")
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations encoded by a plug-in, labels masked up to the assistant's words, cut to 40 ids."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("prompt"), F.col("c_mktsegment").alias("response"))
    found = training.to_examples(training.encoded_chats(rows, training.byte_encoder), longest=40)
    return found.select("c_custkey", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x == training.IGNORED)).alias("masked"))


@query("transcribed_chunks", "SELECT p_partkey, CASE WHEN p_size = 0 THEN '' WHEN p_size <= 8 THEN 'x' || p_size ELSE array_to_string(list_transform(range(1, p_size // 8 + 1), lambda i: 'x8') || CASE WHEN p_size % 8 > 0 THEN ['x' || (p_size % 8)] ELSE [] END, ' ') END AS text FROM part")
def transcribed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser that hears how many samples a piece has, in pieces of half a second at 16 samples a second."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array_repeat(F.lit(0.1), F.col("p_size")).alias("samples"))
    return generation.transcribed(rows, lambda: lambda pieces: [f" x{len(p)} " for p in pieces], key="p_partkey", rate=16, seconds=0.5, batch=3)


@query("failed_extractions", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'no samples' WHEN p_size % 3 = 1 THEN 'ValueError: too short' END AS error, CASE WHEN p_size % 3 = 2 THEN p_size::DOUBLE END AS n FROM part")
def failed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor as a plug-in that fails on some recordings; the error stays with the row."""
    from tracemill.operators import features

    def make():
        def extractor(x, rate):
            if len(x) % 3 == 1:
                raise ValueError("too short")
            return {"n": float(len(x))}

        return extractor

    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.array_repeat(F.lit(0.1), F.col("p_size"))).alias("samples"))
    return features.extract(rows, "p_partkey", make_extractor=make).select("p_partkey", "error", F.col("values")["n"].alias("n"))


@query("copied_files", "SELECT n_name AS handle, CASE WHEN n_nationkey % 2 = 0 THEN 'EXISTS' ELSE 'COPY' END AS status, 8 AS length FROM nation")
def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of copies carried out in tasks; files that are there meanwhile are left."""
    source, dest = wav_folder(spark, sf_dir), new_path(spark, "copies")
    rows = table(spark, sf_dir, "nation")
    writers.write_files(named(rows.filter("n_nationkey % 2 = 0"), F.concat("n_name", F.lit(".flac")), F.lit("before!!")), dest).count()
    plan = rows.select(F.col("n_name").alias("handle"), F.concat(F.lit(source + "/"), "n_name", F.lit(".flac")).alias("source"), F.concat("n_name", F.lit(".flac")).alias("dest"), F.lit("COPY").alias("status"), F.lit(0).alias("code"))
    done = writers.copy_files(plan, dest).select("handle", "status")
    return done.join(readers.files(spark, dest, ("flac",)).select(paths.stem(F.col("path")).alias("handle"), "length"), "handle")


@query("silent_scalars", "SELECT n_name AS stem, 1.0 / (0.5 + (n_nationkey + 1) * 0.25) AS pause_rate, 2.0 / (0.25 + (n_nationkey + 1) * 0.25) AS articulation_rate FROM nation")
def silent_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones of TextGrids as scalars of a recording; the phone without a mark is a pause of a quarter of a second."""
    grids = readers.whole_texts(spark, grid_folder(spark, sf_dir), ("textgrid",)).select(paths.stem(F.col("path")).alias("stem"), readers.textgrid_phones("text").alias("p"))
    held_grids = held(grids, "grids")
    scalars = phonology.phone_scalars(F.col("p"))
    return held_grids.select("stem", scalars["pause_rate"].alias("pause_rate"), scalars["articulation_rate"].alias("articulation_rate"))
