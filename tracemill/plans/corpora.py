"""Corpus queries: paths, lines, side files, schemas, prompts, training arrays, models, resuming."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import paths, text
from tracemill.operators import aligner, corpus, features, generation, held, items, runs, selection, training
from tracemill.plans.registry import query, table
from tracemill.sources import readers
from tracemill.streaming import resume

_TIMIT = "'/data/' || CASE WHEN s_suppkey % 3 = 0 THEN 'TRAIN' WHEN s_suppkey % 3 = 1 THEN 'test' ELSE 'dev' END || '/DR' || (s_suppkey % 10) || '/F' || s_nationkey || '/sa' || s_suppkey || '.WAV'"


@query(
    "path_parse",
    rf"""WITH p AS (SELECT s_suppkey, lower({_TIMIT}) AS p FROM supplier)
    SELECT s_suppkey, CASE WHEN regexp_matches(p, '/(dr[1-8])/([^/]+)/[^/]+$') THEN regexp_extract(p, '/(dr[1-8])/([^/]+)/[^/]+$', 2) ELSE split_part(p, '/', -2) END AS speaker_id, regexp_extract(p, '/(dr[1-8])/', 1) AS dialect_code,
        CASE regexp_extract(p, '/(dr[1-8])/', 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.DIALECTS.items())} ELSE '' END AS dialect, CASE WHEN contains(p, '/train/') THEN 'train' WHEN contains(p, '/test/') THEN 'test' ELSE '' END AS split FROM p""",
)
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", paths.dialect_path(F.expr(_TIMIT)).alias("d")).select("s_suppkey", "d.*")


_SLICE = "CASE doc_id % 5 WHEN 0 THEN 'emo_' || source || '_' || lang || '.wav' WHEN 1 THEN lang || '_01.wav' ELSE source || '_03_' || doc_id || '_' || (doc_id + 1600) || '.WAV' END"


@query(
    "slice_name_parse",
    rf"WITH n AS (SELECT doc_id, {_SLICE} AS n FROM documents) SELECT doc_id, CASE WHEN m THEN regexp_extract(n, '(?i)^(.*)_(\d+)_(\d+)\.wav$', 1) END AS base, CASE WHEN m THEN regexp_extract(n, '(?i)^(.*)_(\d+)_(\d+)\.wav$', 2)::BIGINT END AS start, CASE WHEN m THEN regexp_extract(n, '(?i)^(.*)_(\d+)_(\d+)\.wav$', 3)::BIGINT END AS end, regexp_extract(lower(n), '^emo_([\p{{L}}\p{{N}}_]+)_([\p{{L}}\p{{N}}_]+)\.', 1) AS emotion FROM (SELECT *, regexp_matches(n, '(?i)^(.*)_(\d+)_(\d+)\.wav$') AS m FROM n)",
)
def slice_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(_SLICE)
    return table(spark, sf_dir, "documents").select("doc_id", paths.slice_name(name).alias("s"), paths.emotion_name(name)["emotion"].alias("emotion")).select("doc_id", "s.*", "emotion")


@query("suffix_swap", r"SELECT page_id, regexp_replace(url, '\.[^./]*$', '') || '.AF' AS sidecar, split_part(url, '/', -1) AS name, CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END AS rel FROM pages")
def suffix_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.with_suffix(F.col("url"), ".AF").alias("sidecar"), paths.file_name(F.col("url")).alias("name"), paths.relative(F.col("url"), "https:/").alias("rel"))


_ROUTE = "CASE p_partkey % 4 WHEN 0 THEN 'timit_dataset/train/DR1/' || p_partkey || '.WAV' WHEN 1 THEN 'ears_processed/train/p101/rainbow_' || p_partkey || '_0_153653.wav' WHEN 2 THEN 'ears/short' ELSE 'other/a/b/c.wav' END"


@query("corpus_routing", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'timit' WHEN 1 THEN 'ears' END AS corpus, CASE p_partkey % 4 WHEN 0 THEN p WHEN 1 THEN replace(p, 'ears_processed/', 'ears_dataset/') END AS prepared, CASE p_partkey % 4 WHEN 0 THEN 'TRAIN/DR1/' || p_partkey || '.WAV' WHEN 1 THEN 'p101/rainbow_' || p_partkey || '.wav' END AS source FROM (SELECT p_partkey, {_ROUTE} AS p FROM part)")
def corpus_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr(_ROUTE)
    return table(spark, sf_dir, "part").select("p_partkey", paths.corpus_of(p).alias("corpus"), paths.prepared_path(p).alias("prepared"), paths.source_path(p).alias("source"))


_LINE = "CASE doc_id % 4 WHEN 0 THEN source || chr(9) || lang || ' said' WHEN 1 THEN source || '  ' || lang || ' x' WHEN 2 THEN source ELSE '0 6190 She ' || lang END"


@query(
    "line_parse",
    f"SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN NULL WHEN doc_id % 4 = 3 THEN '0' ELSE source END AS utt_id, CASE doc_id % 4 WHEN 0 THEN lang || ' said' WHEN 1 THEN lang || ' x' WHEN 3 THEN '6190 She ' || lang END AS text, CASE doc_id % 4 WHEN 3 THEN 'She ' || lang WHEN 1 THEN lang || ' x' ELSE {_LINE} END AS spoken FROM documents",
)
def line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(_LINE)
    return table(spark, sf_dir, "documents").select("doc_id", readers.tabbed_transcript(line).alias("t"), readers.first_line_text(line).alias("spoken")).select("doc_id", "t.*", "spoken")


@query("stem_intersection", "SELECT s_nationkey AS stem, 'g' || max(s_suppkey) AS gold, (SELECT 'h' || max(c_custkey) FROM customer WHERE c_nationkey = s_nationkey) AS hyp FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY s_nationkey")
def stem_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda t, stem, key, p: table(spark, sf_dir, t).select(F.col(stem).alias("stem"), F.col(key).alias("rank"), F.concat(F.lit(p), F.col(key).cast("string")).alias("path"))
    return corpus.common_stems(side("supplier", "s_nationkey", "s_suppkey", "g"), side("customer", "c_nationkey", "c_custkey", "h"))


_EXT = "CASE o_orderkey % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'FLAC' WHEN 2 THEN 'mp3' ELSE 'txt' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), F.expr(_EXT).alias("ext"), F.concat(F.col("o_orderkey").cast("string"), F.lit("."), F.expr(_EXT)).alias("path"))


@query(
    "priority_probe",
    f"WITH f AS (SELECT o_custkey AS stem, o_orderkey || '.' || {_EXT} AS path, list_position(['flac', 'wav', 'mp3'], lower({_EXT})) AS r FROM orders) SELECT c_custkey AS stem, (SELECT arg_min(path, (r, path)) FROM f WHERE f.stem = c_custkey AND r > 0) AS path FROM customer",
)
def priority_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.by_preference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stem")), _files(spark, sf_dir), ("flac", "wav", "mp3"))


@query("transcript_preference", f"WITH f AS (SELECT o_custkey AS stem, o_orderkey || '.' || {_EXT} AS path, list_position(['txt', 'wav'], lower({_EXT})) AS r FROM orders) SELECT c_custkey AS stem, (SELECT arg_min(path, (r, path)) FROM f WHERE f.stem = c_custkey AND r > 0) AS path FROM customer")
def transcript_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.by_preference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stem")), _files(spark, sf_dir), ("txt", "wav"))


_STATUS = "SELECT d.doc_id AS utt_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING' WHEN l.toxic = 1 THEN 'EXISTS' ELSE 'WRITE' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "utt_id")
    return corpus.transcript_status(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt_id")), known, known.filter("toxic = 1"), skip_existing=False)


@query("transcript_status", _STATUS)
def transcript_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query("run_summary", f"SELECT count(*) AS total, count(*) FILTER (status = 'WRITE') AS write, count(*) FILTER (status = 'EXISTS') AS exists, count(*) FILTER (status = 'SKIP') AS skip, count(*) FILTER (status = 'MISSING') AS missing FROM ({_STATUS})")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run_summary(_status(spark, sf_dir))


_HANDLE = "CASE WHEN c_custkey % 10 = 0 THEN 'solo' || c_custkey ELSE 'p' || c_nationkey || '_q_' || c_custkey END"


@query(
    "copy_plan",
    f"""WITH h AS (SELECT c_custkey, {_HANDLE} AS handle FROM customer), f AS (SELECT handle, lower({_EXT}) AS e, handle || '.' || {_EXT} AS path FROM h JOIN orders ON o_custkey = c_custkey),
    b AS (SELECT handle, arg_min(path, list_position(['flac', 'wav', 'mp3'], e)) AS source FROM f WHERE e <> 'txt' GROUP BY handle)
    SELECT h.handle, CASE WHEN source IS NULL OR c_custkey % 10 = 0 THEN 'MISSING' ELSE 'COPY' END AS status, CASE WHEN source IS NOT NULL AND c_custkey % 10 > 0 THEN 'train/audio/' || split_part(h.handle, '_', 1) || '/q/' || source END AS dest FROM h LEFT JOIN b ON h.handle = b.handle""",
)
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_HANDLE).alias("handle"))
    found = h.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("handle").alias("stem"), F.expr(_EXT).alias("ext"), F.concat("handle", F.lit("."), F.expr(_EXT)).alias("path"))
    return corpus.copy_plan(h.select("handle"), found).select("handle", "status", "dest")


@query("native_language", "SELECT c_custkey, coalesce(n_name, '') AS native_language FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def native_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("speaker_id"), F.col("n_name").alias("native_language"))
    return corpus.add_language(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("speaker_id")), dim).select("c_custkey", "native_language")


@query("schema_align_union", "SELECT c_name AS filename, '' AS speaker_id, 'c' AS dataset, '' AS split, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey::VARCHAR, 's', '', s_acctbal, NULL FROM supplier")
def schema_align_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("filename"), F.lit("c").alias("dataset"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("filename"), F.col("s_nationkey").cast("string").alias("speaker_id"), F.lit("s").alias("dataset"), F.col("s_acctbal").alias("balance"))
    return corpus.union_corpora([c, s], ("filename", "speaker_id", "dataset", "split"))


@query("files_by_speaker", "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def files_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files_by_speaker(table(spark, sf_dir, "documents"), "source", "lang").withColumnRenamed("n_lang", "n_langs")


@query("prompt_template", "SELECT p_partkey, 'Is ' || p_name || ' of ' || p_brand || ' a ' || p_type || '? ' || p_name AS prompt FROM part")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.fill_template("Is {name} of {brand} a {type}? {name}", {"{name}": F.col("p_name"), "{brand}": F.col("p_brand"), "{type}": F.col("p_type")}).alias("prompt"))


@query("feature_block", "SELECT p_partkey, '{' || chr(10) || '  ''price'': ' || printf('%.2f', p_retailprice) || ',' || chr(10) || '  ''size'': ' || printf('%.2f', p_size::DOUBLE) || ',' || chr(10) || '}' AS block FROM part")
def feature_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", text.feature_block(values, 2).alias("block"))


@query("phoneme_block", "SELECT user_id, '[' || string_agg('(''' || event_type || ''', ' || printf('%.2f', value) || ')', ', ' ORDER BY event_id) || ']' AS block FROM events GROUP BY user_id")
def phoneme_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("phoneme"), F.col("value").alias("duration")))).alias("p"))
    return rows.select("user_id", text.phoneme_block(F.col("p")).alias("block"))


_IDS = "n AS (SELECT conv_id, turn, (1 + length(text) % 40)::INTEGER AS n, (length(text) % 13)::INTEGER AS p FROM conversations)"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (1 + F.length("text") % 40).cast("int").alias("n"), (F.length("text") % 13).cast("int").alias("p"))
    ids = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(1), F.greatest(F.col(n), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return training.to_examples(rows.withColumns({"full_ids": ids("n"), "prompt_ids": ids("p")}), longest=30)


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query("label_mask", f"WITH {_IDS} SELECT conv_id, turn, array_to_string(list_transform(range(1, least(n, 30) + 1), lambda i: CASE WHEN i <= p THEN -100 ELSE i END), ',') AS labels FROM n")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("conv_id", "turn", _joined("labels"))


@query("truncate", f"WITH {_IDS} SELECT conv_id, turn, least(n, 30)::BIGINT AS n, array_to_string(range(1, least(n, 30) + 1), ',') AS input_ids FROM n")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("conv_id", "turn", F.size("input_ids").cast("long").alias("n"), _joined("input_ids"))


@query(
    "pad_to_batch_max",
    f"""WITH {_IDS}, m AS (SELECT *, least(n, 30) AS k, max(least(n, 30)) OVER (PARTITION BY conv_id) AS w FROM n)
    SELECT conv_id, turn, array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN i <= k THEN i ELSE 5 END), ',') AS input_ids, array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN i <= k THEN 1 ELSE 0 END), ',') AS attention_mask,
        array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN i > k OR i = 5 OR i <= p THEN -100 ELSE i END), ',') AS labels FROM m""",
)
def pad_to_batch_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = training.pad_batches(_examples(spark, sf_dir), pad_id=5, batch="conv_id")
    return padded.select("conv_id", "turn", _joined("input_ids"), _joined("attention_mask"), _joined("labels"))


@query(
    "time_pad_mask",
    "WITH e AS (SELECT vec_id, vec_id % 10 AS batch, 1 + vec_id % 7 AS t FROM embeddings), m AS (SELECT *, max(t) OVER (PARTITION BY batch) AS w FROM e) SELECT vec_id, w AS width, array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN i <= t THEN 1 ELSE 0 END), ',') AS feature_attention_mask FROM m",
)
def time_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (1 + F.col("vec_id") % 7).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("batch"), F.array(F.slice("embedding", F.lit(1), t), F.slice("embedding", F.lit(9), t)).alias("input_features"))
    padded = training.pad_time(rows)
    return padded.select("vec_id", F.size(F.col("input_features")[1]).cast("long").alias("width"), _joined("feature_attention_mask"))


@query("training_view", "SELECT 'a' || p_partkey AS audio_path, p_brand AS prompt, p_name AS response, p_type AS answer FROM part WHERE p_size > 10")
def training_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("audio_path"), F.col("p_brand").alias("prompt"), F.concat(F.lit("<THINK>x</THINK>\n<RESPONSE>"), "p_name", F.lit("\n</RESPONSE>")).alias("generated_reasoning"), F.col("p_type").alias("ground_truth_answer"), F.when(F.col("p_size") > 10, "pass").otherwise("fail").alias("validation_status"))
    return selection.to_training_view(final, strip_tags=True)


_STUB = """
    WITH k AS (SELECT conv_id, turn, unnest([0, 1, 2])::INTEGER AS k, coalesce(text, '') AS t FROM conversations),
    m AS (SELECT *, md5(t || ':' || k) AS x FROM k),
    h AS (SELECT *, ('0x' || x[1:8])::UBIGINT::UHUGEINT * 79228162514264337593543950336 + ('0x' || x[9:16])::UBIGINT::UHUGEINT * 18446744073709551616 + ('0x' || x[17:24])::UBIGINT::UHUGEINT * 4294967296 + ('0x' || x[25:32])::UBIGINT::UHUGEINT AS h FROM m),
    p AS (SELECT *, ['f0_level=low', 'speaking_rate=fast', 'vowel_ratio=mid'] AS traits, ['male', 'female'] AS labels FROM h),
    c AS (SELECT *, traits[(h % 3)::INTEGER + 1] AS a, traits[((h // 7) % 3)::INTEGER + 1] AS b, labels[((h // 91) % 2)::INTEGER + 1] AS label FROM p)
    SELECT conv_id, turn, k, '<THINK>' || a || ' and ' || b || ' matter.</THINK>' || chr(10) || '<RESPONSE>Based on features such as ' || a || ', ' || b || ', the speaker is most consistent with: ' || label || '.</RESPONSE>' AS text FROM c
"""


@query("generate_candidates", _STUB)
def generate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates of the stub model for every turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("model_prompt"))
    return selection.explode_candidates(generation.generate(rows, generation.stub_model, n=3)).select("conv_id", "turn", "k", "text")


@query("dsp_features", "SELECT vec_id::VARCHAR AS path, 0.25 AS duration, 100.0 + 10 * label AS pitch FROM embeddings")
def dsp_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal features of tones, whose pitch and length come from the label of a vector."""
    tone = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.sin(i * (F.lit(6.283185307179586) * (100 + 10 * F.col("label")) / 16000)) * 0.1)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), tone.alias("samples"))
    return features.extract(rows).select("path", F.round(F.col("values")["duration"], 4).alias("duration"), (F.round(F.col("values")["pitch_median"] / 5, 0) * 5).alias("pitch"))


@query("voice_features", "SELECT vec_id::VARCHAR AS path, round(16000 / (160 + 4 * label)) AS pitch, true AS f1_near, true AS f2_near, true AS level_near, true AS steady FROM embeddings")
def voice_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a voice made of two resonances, one behind the other (700 and 1,220 Hz), that are struck once a period, which is 160 samples and 4 for each label; its
    loudness comes from the vector's first component. Formants within 5 %, level within 1 dB, jitter below 0.2 %."""
    i, period = F.sequence(F.lit(0), F.lit(3999)), 160 + 4 * F.col("label")
    loud = 0.05 + 0.1 * F.least(F.abs(F.col("embedding")[0]).cast("double"), F.lit(1.0))
    ring = lambda d, hz: F.exp(d * (-60 * math.pi / 16000)) * F.sin(d * (2 * math.pi * hz / 16000))
    wave = F.transform(i, lambda k: loud * (ring(k % period, 700) - 700 / 1220 * ring(k % period, 1220)))
    rows = held.held(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), wave.alias("samples")), "voices")
    size = F.size("samples")
    mean = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) / size
    level = 10 * F.log10((F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x) / size - mean * mean) / 4e-10)
    v = F.col("values")
    near = lambda name, want: F.abs(v[name] - want) < 0.05 * want
    met = features.extract(rows).join(rows.select("path", level.alias("level")), "path")
    return met.select("path", F.round(v["pitch_median"]).alias("pitch"), near("F1_median", 700).alias("f1_near"), near("F2_median", 1220).alias("f2_near"), (F.abs(v["energy_mean"] - F.col("level")) < 1).alias("level_near"), (v["jitter_local"] < 0.002).alias("steady"))


_SPOKEN = "s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), k AS (SELECT user_id, event_id, event_type AS phoneme, (1 + event_id % 5) * 0.01 AS duration FROM s WHERE before IS DISTINCT FROM event_type)"


@query("phone_alignment", f"WITH {_SPOKEN} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, phoneme, round(duration, 4) AS duration FROM k")
def phone_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones are found again in noisy frames: each lasts 1 to 5 frames near the level of its name."""
    levels = {"view": 0.0, "click": 1.0, "purchase": 2.0, "signup": 3.0, "error": 4.0}
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    kept = table(spark, sf_dir, "events").withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type")))
    level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[F.col("event_type")]
    frames = F.transform(F.sequence(F.lit(0), F.col("event_id") % 5), lambda k: level + ((F.col("event_id") * 37 + k * 53) % 101 - 50) / 200)
    spoken = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("phone"), frames.alias("frames")))).alias("x"))
    audio = spoken.select("user_id", F.flatten(F.col("x.frames")).alias("samples"), F.col("x.phone").alias("phones"))
    found = aligner.aligned(audio, lambda: aligner.template_scorer(levels), key="user_id")
    return found.select("user_id", F.posexplode("phones").alias("pos", "p")).select("user_id", "pos", "p.phoneme", F.round("p.duration", 4).alias("duration"))


@query("incremental_resume", "SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY user_id")
def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events past those that an earlier run has done, twice; the second run finds nothing new."""
    events = table(spark, sf_dir, "events")
    path, mark = held.new_path(spark, "resumed"), held.new_path(spark, "marks")
    events.filter("event_id % 3 = 0").select("event_id", "user_id", F.lit(False).alias("fresh")).write.parquet(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    for _ in range(2):
        resume.run_incremental(spark, sf_dir, schema, path, mark, ["event_id"], lambda batch: batch.select("event_id", "user_id", F.lit(True).alias("fresh")), glob="events.parquet")
    return spark.read.schema("event_id long, user_id long, fresh boolean").parquet(path).filter("fresh").groupBy("user_id").agg(F.count("*").alias("n"))


@query("item_pipeline", "SELECT attribute, count(*) AS n, count(DISTINCT c_custkey) AS entries FROM (SELECT c_custkey, 'c_mktsegment' AS attribute FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'c_name' FROM customer WHERE c_custkey % 2 = 1) GROUP BY attribute")
def item_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivot, blocklist and resume composed, as a run composes them."""
    rows = table(spark, sf_dir, "customer")
    found = items.unpivot_attributes(rows, {"c_mktsegment": "Which segment?", "c_name": "Which name?"}, ["c_custkey"])
    done = rows.filter("c_custkey % 2 = 0").select("c_custkey")
    return found.transform(items.drop_blocked, blocked=("machinery",)).transform(items.not_done, done, ["c_custkey"]).groupBy("attribute").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("entries"))


_GENDER, _AGE = "CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END", "CASE WHEN c_custkey % 2 = 0 THEN '18-25' END"
_RUN = f"""
    WITH i AS (SELECT c_custkey::VARCHAR AS audio_path, c_acctbal AS v, unnest([{{'prompt': 'What is the speaker''s gender?', 'answer': {_GENDER}}}, {{'prompt': 'What is the speaker''s age?', 'answer': {_AGE}}}]) AS x FROM customer),
    k AS (SELECT audio_path, v, x.prompt AS prompt, x.answer AS answer FROM i WHERE x.answer IS NOT NULL), q AS (SELECT quantile_cont(v, 0.33) AS a, quantile_cont(v, 0.66) AS b FROM k)
    SELECT audio_path, prompt, answer, CASE WHEN v <= a THEN 'low' WHEN v <= b THEN 'mid' ELSE 'high' END AS f0_level FROM k, q WHERE NOT (prompt LIKE '%age%' AND answer = '18-25' AND audio_path::BIGINT % 10 = 0)
"""


@query("run_items", _RUN)
def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from entries to items with traits: side files attached, quantiles fitted over items, what is done left out after the fit."""
    rows = table(spark, sf_dir, "customer").withColumn("audio_path", F.col("c_custkey").cast("string"))
    speaker = F.struct(F.expr(_GENDER).alias("gender"), F.expr(_AGE).alias("age"), *[F.lit(None).cast("string").alias(c) for c in ("dialect_region", "ethnicity")])
    entries = rows.select("audio_path", F.col("c_name").alias("transcript"), F.when(F.col("c_custkey") % 6 != 5, speaker).alias("speaker"))
    features = rows.select("audio_path", F.create_map(F.lit("pitch_mean"), F.col("c_acctbal")).alias("values"))
    phones = rows.select("audio_path", F.array().cast("array<struct<phoneme:string,duration:double>>").alias("phones"))
    done = rows.filter("c_custkey % 10 = 0").select("audio_path", F.lit("What is the speaker's age?").alias("prompt"))
    found = runs.items_with_traits(entries, features, phones, done=done)
    return found.select("audio_path", "prompt", F.col("ground_truth_answer").alias("answer"), F.col("latent_json.acoustic.f0_level").alias("f0_level"))
