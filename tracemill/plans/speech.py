"""Utterance queries: users stand for utterances, event types for phones, values for durations and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import phonology, text, validation
from tracemill.operators import features, items, latents
from tracemill.plans.registry import query, table

#: What the event types stand for.
PHONES = {"view": "a", "click": "aj", "purchase": "ɹ", "signup": "m̩", "error": ""}

_PHONE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PHONES.items()) + " END"
_PARTS = f"""e AS (SELECT user_id, {_PHONE} AS ph, value AS d FROM events),
    a AS (SELECT user_id, count(*) FILTER (ph <> '') AS n, coalesce(sum(d) FILTER (ph <> ''), 0) AS s, count(*) FILTER (ph = '') AS q, coalesce(sum(d) FILTER (ph = ''), 0) AS qs,
                 count(*) FILTER (ph IN ('a', 'aj')) AS v, count(*) FILTER (ph = 'ɹ') AS r, count(*) FILTER (ph = 'aj') AS di, count(*) FILTER (ph = 'm̩') AS sy,
                 avg(d) AS pm, stddev_pop(d) AS ps, median(d) AS pd, max(d) AS mx, min(d) AS mn, coalesce(avg(d) FILTER (ph = 'a'), 0) AS f1, coalesce(avg(d) FILTER (ph = 'aj'), 0) AS f2 FROM e GROUP BY user_id)"""
_SCALARS = {
    "f0_mean": "pm",
    "f0_std": "ps",
    "f0_skew_proxy": "pm - pd",
    "energy_mean": "mx",
    "energy_var_proxy": "mx - mn",
    "snr_proxy": "0.0",
    "jitter": "0.0",
    "shimmer": "mn",
    "vowel_space_scale": "CASE WHEN f1 > 0 AND f2 > 0 THEN (CASE WHEN f2 > 1e-6 THEN ln(f2) ELSE 0 END) - (CASE WHEN f1 > 1e-6 THEN ln(f1) ELSE 0 END) ELSE 0.0 END",
    "front_back_tilt": "f2",
    "articulation_rate": "CASE WHEN s > 0 THEN n / s ELSE 0.0 END",
    "mean_phone_dur": "CASE WHEN n > 0 THEN s / n ELSE 0.0 END",
    "pause_rate": "CASE WHEN s + qs > 0 THEN q / (s + qs) ELSE 0.0 END",
    "vowel_ratio": "CASE WHEN n > 0 THEN v / n ELSE 0.0 END",
    "rhotic_ratio": "CASE WHEN n > 0 THEN r / n ELSE 0.0 END",
    "diphthong_ratio": "CASE WHEN v > 0 THEN di / v ELSE 0.0 END",
    "has_syllabic": "CASE WHEN sy > 0 THEN 1.0 ELSE 0.0 END",
}
_U = f"{_PARTS}, u AS (SELECT user_id, {', '.join(f'({x})::DOUBLE AS {k}' for k, x in _SCALARS.items())} FROM a)"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, features, phones): a map and an array, as side files have them.

    Means and deviations are summed in the order of the phones. An aggregate sums as its partitions come, so that the same phones
    may differ in the last bit, which is enough to part them where they lie on the edge of a trait."""
    table_of = F.create_map(*[F.lit(x) for kv in PHONES.items() for x in kv])
    phone, v = table_of[F.col("event_type")], F.col("value")
    phones = F.transform(F.array_sort(F.collect_list(F.struct("event_id", phone.alias("phoneme"), v.alias("duration")))), lambda x: F.struct(x["phoneme"].alias("phoneme"), x["duration"].alias("duration")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(phones.alias("phones"), F.median(v).alias("median"), F.max(v).alias("max"), F.min(v).alias("min"))
    timed = F.filter("phones", lambda x: x["duration"].isNotNull())
    series = lambda p: F.transform(F.filter("timed", lambda x: x["phoneme"] == p) if p else F.col("timed"), lambda x: x["duration"])
    whole = features.array_summary(F.col("values"))
    made = {"pitch_mean": whole["mean"], "pitch_std": whole["std"], "pitch_median": F.col("median"), "energy_mean": F.col("max"), "energy_max": F.col("max"), "energy_min": F.col("min"), "shimmer_local": F.col("min")}
    made |= {k: features.array_summary(F.col(k))["mean"] for k in ("F1_mean", "F2_mean")}
    rows = rows.withColumn("timed", timed).withColumns({"values": series(None), "F1_mean": series("a"), "F2_mean": series("aj")})
    return rows.select("user_id", F.create_map(*[x for k, c in made.items() for x in (F.lit(k), c)]).alias("features"), "phones")


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("user_id", *[c.alias(n) for n, c in phonology.scalars(F.col("features"), F.col("phones")).items()])


@query("phone_scalars", f"WITH {_U} SELECT user_id, {', '.join(f'round({k}, 6) AS {k}' for k in list(_SCALARS)[10:])} FROM u")
def phone_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars(spark, sf_dir).select("user_id", *[F.round(k, 6).alias(k) for k in list(_SCALARS)[10:]])


@query("acoustic_scalars", f"WITH {_U} SELECT user_id, {', '.join(f'round({k} + 1e-9, 4) AS {k}' for k in list(_SCALARS)[:10])} FROM u")
def acoustic_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A little is added before rounding, so that means that lie on an edge go the same way whatever the order of sums."""
    return scalars(spark, sf_dir).select("user_id", *[F.round(F.col(k) + 1e-9, 4).alias(k) for k in list(_SCALARS)[:10]])


_LABEL = "CASE WHEN {0} <= {0}_33 THEN '{1[0]}' WHEN {0} <= {0}_66 THEN '{1[1]}' ELSE '{1[2]}' END AS {2}"
_TRAITS = {**phonology.ACOUSTIC, **phonology.PHONOLOGY}
_FIT = ", ".join(f"quantile_cont({k}, 0.33) AS {k}_33, quantile_cont({k}, 0.66) AS {k}_66" for k, _ in _TRAITS.values())
_LATENT = f"{_U}, q AS (SELECT {_FIT} FROM u), t AS (SELECT user_id, {', '.join(_LABEL.format(s, ls, t) for t, (s, ls) in _TRAITS.items())}, CASE WHEN has_syllabic > 0.5 THEN 'present' ELSE 'absent' END AS syllabic_consonants FROM u, q)"


@query("latent_traits", f"WITH {_LATENT} SELECT user_id, {', '.join([*_TRAITS, 'syllabic_consonants'])} FROM t")
def latent_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latents.traits(scalars(spark, sf_dir))
    return found.select("user_id", "latent_json.acoustic.*", "latent_json.phonology.*")


@query("flatten_json", f"WITH {_LATENT} SELECT user_id, 'f0_level=' || f0_level || ';speaking_rate=' || speaking_rate AS pairs, 17::BIGINT AS n FROM t")
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = latents.flattened(F.col("latent_json"))
    found = latents.traits(scalars(spark, sf_dir)).withColumn("flat", flat)
    return found.select("user_id", F.concat(F.lit("f0_level="), F.col("flat")["f0_level"], F.lit(";speaking_rate="), F.col("flat")["speaking_rate"]).alias("pairs"), (F.size("flat") - 1).cast("long").alias("n"))


_ASKS = {0: "What is the speaker's gender?", 1: "What is the speaker's dialect?", 2: "Who speaks?"}


@query(
    "preferred_by_question",
    f"WITH {_LATENT} SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'f0_level=' || f0_level WHEN 1 THEN 'speaking_rate=' || speaking_rate END AS first, CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 7 END AS n, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN f0_level = '' END AS kept FROM t",
)
def preferred_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traits that each question prefers, and whether a trace that names the pitch alone keeps to them."""
    prompts = F.create_map(*[F.lit(x) for kv in _ASKS.items() for x in kv])
    found = latents.traits(scalars(spark, sf_dir)).select("user_id", "latent_json", prompts[(F.col("user_id") % 3).cast("int")].alias("prompt"))
    preferred = validation.preferred_pairs(F.col("prompt"), F.col("latent_json"))
    named = F.concat(F.lit("f0_level="), F.col("latent_json.acoustic.f0_level"))
    trace = F.concat(F.lit("<THINK>"), named, F.lit("</THINK><RESPONSE>x</RESPONSE>"))
    rows = found.withColumns({"p": preferred, "trace": trace, "own": F.array(named)})
    kept = validation.rubric(F.col("trace"), F.col("own"), F.array(F.lit("x")), F.col("p"))["preferred_traits"]
    return rows.select("user_id", F.col("p")[0].alias("first"), F.when(F.col("p").isNotNull(), F.size("p")).alias("n"), kept.alias("kept"))


@query(
    "summary_stats",
    "SELECT user_id, round(avg(value), 4) AS v_mean, round(stddev_pop(value), 4) AS v_std, round(median(value), 4) AS v_median, round(max(value) - min(value), 4) AS v_range, round(var_pop(value), 3) AS v_var, round(max(value), 4) AS v_max, round(min(value), 4) AS v_min FROM events WHERE value > 0 GROUP BY user_id",
)
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("value > 0").groupBy("user_id").agg(*features.summary(F.col("value"), "v"))
    return rows.select("user_id", *[F.round(c, 3 if c == "v_var" else 4).alias(c) for c in rows.columns[1:]])


@query(
    "frame_summary",
    "SELECT user_id, count(*) FILTER (value > 0 AND value <> 6.55) AS n, round(coalesce(avg(value) FILTER (value > 0 AND value <> 6.55), 0), 4) AS mean, round(coalesce(stddev_pop(value) FILTER (value > 0 AND value <> 6.55), 0), 4) AS std, round(coalesce(median(value) FILTER (value > 0 AND value <> 6.55), 0), 4) AS median FROM events GROUP BY user_id",
)
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames within a row: some are NaN, which don't count."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("value") == 6.55, F.lit(float("nan"))).otherwise(F.col("value"))).alias("x"))
    rows = rows.withColumn("x", features.good_frames(F.col("x"), "pitch"))
    s = features.array_summary(F.col("x"))
    return rows.select("user_id", F.size("x").cast("long").alias("n"), *[F.round(s[k], 4).alias(k) for k in ("mean", "std", "median")])


_FIT_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS scalar, round(quantile_cont({c}, 0.33), 4) AS q33, round(quantile_cont({c}, 0.66), 4) AS q66, min({c}) AS min, max({c}) AS max FROM lineitem" for c in ("l_extendedprice", "l_quantity", "l_tax"))


@query("quantile_fit", _FIT_ROWS)
def quantile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latents.fit(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])
    return found.select("scalar", F.round("q33", 4).alias("q33"), F.round("q66", 4).alias("q66"), "min", "max")


@query("quantile_fit_by_rank", _FIT_ROWS)
def quantile_fit_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latents.fit_by_rank(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])
    return found.select("scalar", F.round("q33", 4).alias("q33"), F.round("q66", 4).alias("q66"), "min", "max")


_ASKED = {"c_mktsegment": "What is the segment?", "c_name": "What is the name?", "region": "What is the region?"}
_ENTRIES = "x AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment, c_name, CASE WHEN c_nationkey % 2 = 0 THEN r_name END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_ITEMS = f"{_ENTRIES}, i AS (" + " UNION ALL ".join(f"SELECT c_custkey, c_acctbal, '{a}' AS attribute, '{p}' AS prompt, {a} AS answer FROM x WHERE {a} IS NOT NULL" for a, p in zip(_ASKED, (p.replace("'", "''") for p in _ASKED.values()))) + ")"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_name", F.when(F.col("c_nationkey") % 2 == 0, F.col("r_name")).alias("region"))


@query("attribute_unpivot", f"WITH {_ITEMS} SELECT c_custkey, attribute, prompt, answer FROM i")
def attribute_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.unpivot_attributes(entries(spark, sf_dir), _ASKED, ["c_custkey"]).drop("pos")


@query("unpivot_null_drop", f"WITH {_ITEMS} SELECT attribute, count(*) AS n FROM i GROUP BY attribute")
def unpivot_null_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.unpivot_attributes(entries(spark, sf_dir), _ASKED, ["c_custkey"]).groupBy("attribute").agg(F.count("*").alias("n"))


@query(
    "latent_bins_weighted",
    f"WITH {_ITEMS}, q AS (SELECT quantile_cont(c_acctbal, 0.33) AS a, quantile_cont(c_acctbal, 0.66) AS b FROM i) SELECT attribute, CASE WHEN c_acctbal <= a THEN 'low' WHEN c_acctbal <= b THEN 'mid' ELSE 'high' END AS bin, count(*) AS n FROM i, q GROUP BY ALL",
)
def latent_bins_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles over items, so an entry counts once for each of its attributes."""
    rows = items.unpivot_attributes(entries(spark, sf_dir), _ASKED, ["c_custkey", "c_acctbal"])
    binned = latents.apply(rows, latents.fit_row(rows, ["c_acctbal"]), {"c_acctbal": phonology.LMH})
    return binned.groupBy("attribute", F.col("c_acctbal_bin").alias("bin")).agg(F.count("*").alias("n"))


_WORDS = (("gender", items.CANDIDATES["gender"]), ("age", items.CANDIDATES["age"]), ("dialect", items.CANDIDATES["dialect"]), ("ethnicity", items.CANDIDATES["ethnicity"]))
_PROMPT = "CASE o_orderkey % 6 WHEN 0 THEN 'What is the Gender?' WHEN 1 THEN 'Which language?' WHEN 2 THEN 'Name the dialect' WHEN 3 THEN 'ethnicity and age' WHEN 4 THEN 'ethnicity' ELSE 'other' END"


@query("candidate_list", f"WITH p AS (SELECT o_orderkey, lower({_PROMPT}) AS p FROM orders) SELECT o_orderkey, CASE " + " ".join(f"WHEN contains(p, '{w}') THEN '{', '.join(v)}'" for w, v in _WORDS) + " ELSE '' END AS candidates FROM p")
def candidate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PROMPT).alias("prompt"))
    return prompts.select("o_orderkey", text.choices(items.candidates_for(F.col("prompt"))).alias("candidates"))


@query(
    "entry_limit",
    "SELECT o_orderkey, n FROM (SELECT o_orderkey, 1 + o_orderkey % 4 AS n, coalesce(sum(1 + o_orderkey % 4) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 1000",
)
def entry_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entries that make 1000 items, the last of which may go beyond: the limit is the feature."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 4).alias("n"))
    return items.limit_entries(rows, F.col("n"), 1000, ["o_orderkey"])


@query("resolve_transcript", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN lang END, 'heard ' || source) AS transcript FROM documents")
def resolve_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("t"), F.concat(F.lit("heard "), "source").alias("heard"))
    return rows.select("doc_id", items.resolve_transcript(F.col("t"), F.col("heard")).alias("transcript"))


@query("resume_anti_join", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return items.not_done(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), done, ["l_orderkey"])


@query("blocklist_filter", "SELECT p_partkey, a AS answer FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'prefer not to answer' WHEN 2 THEN NULL ELSE p_type END AS a FROM part) WHERE coalesce(lower(trim(a)), '') NOT IN ('prefer not to answer', 'non-binary / third gender', 'unknown')")
def blocklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, " Unknown ").when(k == 1, "prefer not to answer").when(k > 2, F.col("p_type")).alias("answer"))
    return items.drop_blocked(rows)


@query("first_hit_dedupe", "SELECT md5(text) AS h, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)")
def first_hit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.first_of_group(table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id", "source"), ["h"], ["doc_id"])


@query("first_n_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 documents of each source: the limit is the feature."""
    return items.first_n_of_group(table(spark, sf_dir, "documents").select("source", "doc_id"), 20, ["source"], ["doc_id"])


@query("batch_assign", "SELECT doc_id, idx, idx // 200 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.batched(table(spark, sf_dir, "documents").select("doc_id"), 200, ["doc_id"], index="idx")


@query("sample_k", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':11785'), doc_id LIMIT 50")
def sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 is the feature."""
    return items.sample_k(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


@query("head_k", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 1000")
def head_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1000 rows are the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(1000)
