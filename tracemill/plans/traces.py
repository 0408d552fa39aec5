"""Trace queries: traces are made up from parts, replies of a judge from events; labels are taken from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text, validation
from tracemill.operators import evaluation, selection
from tracemill.plans.registry import query, table

#: Traces of eight kinds by part: good, without tags, with units and a wrong trait, with one trait, loose, bare, with a wrong label, tags in lower case.
_GOOD = "'Based on features such as color=' || c || ', kind=' || k || ', the speaker is most consistent with: ' || p_type || '.'"
_TRACE = f"""CASE p_partkey % 8
    WHEN 0 THEN '<THINK>color=' || c || ' it is</THINK> <RESPONSE>' || {_GOOD} || '</RESPONSE>'
    WHEN 1 THEN {_GOOD}
    WHEN 2 THEN '<THINK>about 120 Hz and 5 MS kind=none kind=none</THINK><RESPONSE>' || {_GOOD} || '</RESPONSE>'
    WHEN 3 THEN '<THINK>kind=' || k || '</THINK> <RESPONSE>Based on features such as size=' || p_size || ', the speaker is most consistent with: ' || p_type || '</RESPONSE>'
    WHEN 4 THEN '<THINK>x</THINK> <RESPONSE>It is consistent with: ' || p_type || '. Yes</RESPONSE>'
    WHEN 5 THEN '<THINK>x</THINK> <RESPONSE>' || p_type || '</RESPONSE>'
    WHEN 6 THEN '<THINK>x</THINK> <RESPONSE>' || replace({_GOOD}, p_type, 'nothing such') || '</RESPONSE>'
    ELSE '<think>color=' || c || '</think> <response>' || {_GOOD} || '</response>' END"""
_TRACES = f"r AS (SELECT p_partkey, p_type, p_size, split_part(p_name, ' ', 1) AS c, split_part(p_name, ' ', 2) AS k FROM part), t AS (SELECT p_partkey, p_type, c, k, {_TRACE} AS text FROM r)"
_THINK = r"trim(regexp_extract(text, '(?is)<THINK>(.*?)</THINK>\s*<RESPONSE>(.*?)</RESPONSE>', 1))"
_RESP = r"trim(regexp_extract(text, '(?is)<THINK>(.*?)</THINK>\s*<RESPONSE>(.*?)</RESPONSE>', 2))"
_BLOCKS = f"{_TRACES}, b AS (SELECT *, {_THINK} AS think, {_RESP} AS response FROM t)"
_SHAPE = r"(?im)Based on features such as\s+(.+?),\s+the speaker is most consistent with:\s+(.+?)[\.\s]*$"
_PARSED = rf"{_BLOCKS}, s AS (SELECT *, regexp_extract(response, '{_SHAPE}', 1) AS traits, regexp_extract(response, '{_SHAPE}', 2) AS shaped FROM b), l AS (SELECT *, CASE WHEN shaped <> '' THEN shaped WHEN contains(response, 'consistent with:') THEN trim(split_part(trim(regexp_extract(response, '(?s)^.*consistent with:(.*)$', 1)), '.', 1)) END AS label FROM s)"
_CANDS = ("economy", "small", "standard", "promo brushed")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("c"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("k"))
    return rows.select("p_partkey", "p_type", "c", "k", F.expr(_TRACE).alias("text"))


def _pairs():
    return F.array(F.concat(F.lit("color="), "c"), F.concat(F.lit("kind="), "k"))


def _candidates():
    return F.array(*map(F.lit, _CANDS))


@query("block_parse", f"WITH {_BLOCKS} SELECT p_partkey, think, response FROM b")
def block_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("p_partkey", validation.think_of(F.col("text")).alias("think"), validation.response_of(F.col("text")).alias("response"))


@query("kv_extract", r"SELECT page_id, array_to_string(regexp_extract_all(url, '[\p{L}\p{N}_]+=[\p{L}\p{N}_|]+'), ';') AS pairs FROM pages")
def kv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(validation.pairs_in(F.col("url")), ";").alias("pairs"))


@query("forbidden_units", rf"WITH {_BLOCKS} SELECT p_partkey, regexp_extract(think, '(?i)\b(Hz|kHz|ms|sec|seconds)\b', 1) AS unit FROM b")
def forbidden_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("p_partkey", validation.unit_in(validation.think_of(F.col("text"))).alias("unit"))


@query("template_match", f"WITH {_PARSED} SELECT p_partkey, traits, label FROM l")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = validation.response_of(F.col("text"))
    return traces(spark, sf_dir).select("p_partkey", validation.traits_of(response).alias("traits"), validation.label_of(response).alias("label"))


_FITS = " OR ".join(f"(lab = '{c}' OR (length('{c}') > 3 AND contains(lab, '{c}')) OR (length(lab) > 3 AND contains('{c}', lab)))" for c in _CANDS)
_LAB = r"lower(trim(regexp_replace(label, '[^a-zA-Z0-9\s\-/]', '', 'g')))"


@query("label_fuzzy", f"WITH {_PARSED}, f AS (SELECT p_partkey, {_LAB} AS lab FROM l) SELECT p_partkey, lab, {_FITS} AS fits FROM f")
def label_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = validation.label_of(validation.response_of(F.col("text")))
    both = text.let(label, lambda x: F.struct(F.lower(validation.clean_label(x)).alias("lab"), validation.label_fits(x, _candidates()).alias("fits")))
    return traces(spark, sf_dir).select("p_partkey", F.inline(F.array(both)))


_BAD = r"len(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+=[\p{{L}}\p{{N}}_|]+'), lambda p: p <> 'color=' || c AND p <> 'kind=' || k))"
_COUNTS = rf"""WITH {_PARSED}, f AS (SELECT *, {_LAB} AS lab FROM l),
    n AS (SELECT p_partkey, think, response, traits, label, (regexp_matches(think, '(?i)\b(Hz|kHz|ms|sec|seconds)\b'))::INT AS units, {_BAD.format('think')} AS bad_think, {_BAD.format('traits')} AS bad_traits,
        len(regexp_extract_all(traits, '[\p{{L}}\p{{N}}_]+=[\p{{L}}\p{{N}}_|]+')) AS named, (NOT coalesce({_FITS}, false))::INT AS unfit FROM f)
    SELECT p_partkey, (CASE WHEN think = '' OR response = '' THEN 1
        WHEN traits <> '' THEN units + bad_think + (named < 2)::INT + bad_traits + unfit
        WHEN label IS NOT NULL THEN units + bad_think + 1 + unfit ELSE units + bad_think + 1 END)::BIGINT AS n_violations FROM n"""


@query("hard_validate", f"{_COUNTS}")
def hard_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.violations(F.col("text"), _pairs(), _candidates())
    return traces(spark, sf_dir).select("p_partkey", F.size(found).cast("long").alias("n_violations"))


_REPLY = """CASE event_id % 7 WHEN 0 THEN '{}' WHEN 1 THEN 'Sure: ```json\n{"checks": {"a": true, "b": true}, "violations": [],}\n``` done' WHEN 2 THEN '{"checks": {"a": true, "b": false}}'
    WHEN 3 THEN '{"checks": {"a": true}, "violations": ["digit"]}' WHEN 4 THEN 'no json' WHEN 5 THEN '{"checks": {"a": true,}}' ELSE props END"""
_CLEAN = r"regexp_replace(CASE WHEN contains(reply, '```') THEN trim(split_part(regexp_extract(reply, '(?s)^.*```json(.*)$', 1), '```', 1), E' \n') ELSE trim(reply) END, ',\s*([}\]])', '\1', 'g')"
_REPLIES = f"r AS (SELECT event_id, {_REPLY} AS reply FROM events), j AS (SELECT event_id, {_CLEAN} AS clean FROM r)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_REPLY.replace("\n    ", " ")).alias("reply"))


@query("fence_cleanup", f"WITH {_REPLIES} SELECT event_id, clean FROM j")
def fence_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("event_id", validation.clean_json(F.col("reply")).alias("clean"))


@query(
    "soft_verdict",
    f"""WITH {_REPLIES}, v AS (SELECT event_id, clean, json_valid(clean) AS ok FROM j),
    w AS (SELECT event_id, clean, ok, CASE WHEN ok THEN coalesce(json_extract(clean, '$.checks')::VARCHAR, '') END AS checks, CASE WHEN ok THEN coalesce(json_extract_string(clean, '$.violations[0]'), '') END AS said FROM v)
    SELECT event_id, coalesce(ok AND NOT contains(checks, 'false') AND said = '', false) AS passed,
        CASE WHEN NOT ok THEN 'Soft Val JSON Parse Error | Resp: ' || clean || '...' WHEN said <> '' THEN '[' || said || ']' WHEN contains(checks, 'false') THEN 'Soft checks failed' END AS reason FROM w""",
)
def soft_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("event_id", validation.soft_verdict(F.col("reply")).alias("v")).select("event_id", "v.*")


_SAID = "CASE conv_id % 4 WHEN 0 THEN 'This does PASS.' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass or fail' ELSE text END"


@query("verdict_tristate", f"SELECT conv_id, turn, CASE WHEN contains(s, 'pass') AND NOT contains(s, 'fail') THEN true WHEN contains(s, 'fail') AND NOT contains(s, 'pass') THEN false END AS valid FROM (SELECT conv_id, turn, lower({_SAID}) AS s FROM conversations)")
def verdict_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.verdict(F.expr(_SAID)).alias("valid"))


_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STRIP = "regexp_replace({0}, '^{1}|{1}$', '', 'g')"
_LINES = r"regexp_extract(s, '([^\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]*)$', 1)"
_DOC = "CASE doc_id % 5 WHEN 0 THEN text || ' Most Consistent With: Male ..' WHEN 1 THEN 'It is' || chr(10) || 'what it is new' ELSE text END"


@query(
    "extract_label",
    rf"""WITH a AS (SELECT doc_id, {_STRIP.format(_DOC, _WS)} AS s FROM documents), b AS (SELECT doc_id, s, {_STRIP.format(_LINES, _WS)} AS line FROM a),
    c AS (SELECT doc_id, s, CASE WHEN contains(lower(s), 'most consistent with:') THEN regexp_extract(s, '(?is)^.*most consistent with:(.*)$', 1)
        WHEN contains(lower(line), ' is ') THEN regexp_extract(line, '(?is)^.* is (.*)$', 1) ELSE line END AS part FROM b)
    SELECT doc_id, CASE WHEN s <> '' THEN lower(regexp_replace({_STRIP.format('part', _WS)}, '^\.+|\.+$', '', 'g')) END AS label FROM c""",
)
def extract_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.extract_label(F.expr(_DOC)).alias("label"))


@query("final_answer_tail", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN turn || '</FINAL_ANSWER>' ELSE role END AS tail FROM conversations")
def final_answer_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit("<FINAL_ANSWER>a<FINAL_ANSWER> "), F.col("turn").cast("string"), F.lit("</FINAL_ANSWER>\n"))).otherwise(F.concat(F.lit(" "), "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.final_answer_tail(made).alias("tail"))


@query("ensure_closing_tag", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || '</RESPONSE>' ELSE role || chr(10) || '</RESPONSE>' END AS text FROM conversations")
def ensure_closing_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit("</RESPONSE> "))).otherwise(F.concat("role", F.lit("\n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.ensure_closing_tag(made).alias("text"))


_PHRASES = ("High pitch here", "low PITCH and biracial", "high rhoticity", "low rhoticity, Hefei dialect", "nothing")


@query(
    "reasoning_issues",
    f"""WITH x AS (SELECT conv_id, turn, lower((['{"', '".join(_PHRASES)}'])[1 + conv_id % 5]) AS g, lower((['{"', '".join(_PHRASES)}'])[1 + turn % 5]) AS p FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(g, '{a}') AND contains(p, '{b}') THEN 'GT has ''{a}'' but prediction says ''{b}''' END" for a, b in text.OPPOSITES)},
        CASE WHEN contains(p, 'biracial') THEN 'Mentions ''biracial'' (not annotated in ground-truth labels).' END,
        CASE WHEN contains(p, 'jianghuai mandarin') OR contains(p, 'hefei dialect') THEN 'Mentions non-existent dialect label (e.g., Jianghuai Mandarin).' END], lambda i: i IS NOT NULL), '; ') AS issues FROM x""",
)
def reasoning_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = F.array(*map(F.lit, _PHRASES))
    pick = lambda c: F.element_at(phrases, (F.col(c) % 5 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.reasoning_issues(pick("conv_id"), pick("turn")), "; ").alias("issues"))


_HARD, _SOFT = "value > 20", "event_type <> 'view'"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    return rows.select("user_id", "day", F.col("event_id").alias("k"), F.col("event_type").alias("text"), "value", F.expr(_SOFT).alias("soft_passed"), F.concat(F.lit("["), "props", F.lit("]")).alias("soft_reason"), F.array(F.concat(F.lit("low "), "event_type")).alias("violations"))


@query("first_passing_candidate", f"SELECT user_id, day(ts) AS day, arg_min(event_id, event_id) FILTER ({_HARD}) AS k, arg_min(event_type, event_id) FILTER ({_HARD}) AS text FROM events GROUP BY user_id, day(ts)")
def first_passing_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = selection.first_passing(candidates(spark, sf_dir), ["user_id", "day"], F.expr(_HARD))
    return got.select("user_id", F.col("day").cast("long").alias("day"), "chosen.k", "chosen.text")


@query(
    "finalise_status",
    f"""WITH c AS (SELECT user_id, day(ts) AS day, arg_min({{'t': event_type, 's': {_SOFT}, 'p': props}}, event_id) FILTER ({_HARD}) AS c, arg_min(event_type, event_id) AS f FROM events GROUP BY user_id, day(ts))
    SELECT user_id, day, CASE WHEN c IS NULL THEN f ELSE c.t END AS generated_reasoning, CASE WHEN coalesce(c.s, false) THEN 'pass' ELSE 'fail' END AS validation_status,
        CASE WHEN c IS NULL THEN 'Hard Fail: [''low ' || f || ''']' WHEN NOT c.s THEN '[' || c.p || ']' END AS fail_reason FROM c""",
)
def finalise_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = selection.first_passing(candidates(spark, sf_dir), ["user_id", "day"], F.expr(_HARD))
    return selection.finalise(got).withColumn("day", F.col("day").cast("long"))


@query("best_candidate", f"SELECT user_id, day(ts) AS day, coalesce(min(event_id) FILTER ({_HARD} AND {_SOFT}), min(event_id) FILTER ({_HARD})) AS k FROM events GROUP BY user_id, day(ts)")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = selection.first_passing(candidates(spark, sf_dir), ["user_id", "day"], F.expr(_HARD), F.col("soft_passed"), policy="best")
    return got.select("user_id", F.col("day").cast("long").alias("day"), "chosen.k")


_JUDGED = "SELECT d.doc_id, source, 'It is ' || CASE WHEN quality = 1 THEN 'Good' ELSE 'Bad' END || '.' AS answer, 'most consistent with: ' || CASE WHEN n_chars > 500 THEN 'good' ELSE 'bad' END AS pred_text, (n_chars > 500) = (quality = 1) AS correct FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    said = F.concat(F.lit("It is "), F.when(F.col("quality") == 1, "Good").otherwise("Bad"), F.lit("."))
    return evaluation.judged(rows.select("doc_id", "source", said.alias("answer"), F.concat(F.lit("most consistent with: "), F.when(F.col("n_chars") > 500, "good").otherwise("bad")).alias("pred_text")))


@query("accuracy", f"SELECT count(*) AS n, count(*) FILTER (correct) AS n_correct, coalesce(round(avg(correct::INT), 6), 0) AS accuracy FROM ({_JUDGED})")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(answers(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query("accuracy_by_group", f"SELECT source, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 6) AS accuracy FROM ({_JUDGED}) GROUP BY source")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(answers(spark, sf_dir), ["source"]).withColumn("accuracy", F.round("accuracy", 6))


#: For each kind of trace its text and the rules that it breaks, by their first letters: f, o, n, l, t, u, r.
_GOOD = "Based on features such as f0_level=low, voice_stability=unstable, the speaker is most consistent with: {}"
_KINDS = (
    ("f0_level=low voice_stability=unstable", _GOOD.format("male."), ""),
    ("f0_level=low", _GOOD.format("18-25"), ""),
    ("about 120 f0_level=low", _GOOD.format("male."), "n"),
    ("the mean f0_level=low", _GOOD.format("male.") + "</RESPONSE><RESPONSE>more", "fn"),
    ("f0_level=low", "Based on features such as f0_level=low, the speaker is most consistent with: male.", "r"),
    ("f0_level=high", _GOOD.format("male."), "t"),
    ("f0_level=low", _GOOD.format("robot."), "l"),
    ("f0_level=low", _GOOD.format("male. Yes, indeed."), "o"),
    ("f0_level=low voice_stability=unstable", "It is male", "olu"),
)
_RULES = {"f": "format_blocks_present", "o": "response_one_sentence", "n": "no_numbers_or_units", "l": "label_in_candidates", "t": "traits_match_latent_values", "u": "uncertainty_tone_ok", "r": "reasoning_sufficient"}
_BROKEN = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{k[2]}'" for i, k in enumerate(_KINDS)) + " END"


@query("rubric_checks", f"SELECT p_partkey, {', '.join(f"NOT contains({_BROKEN}, '{k}') AS {n}" for k, n in _RULES.items())}, p_partkey % 9 <> 4 OR p_size % 2 = 0 AS preferred_traits FROM part")
def rubric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that need no judge, over traces that break them in known ways; of the preferred traits each names one, but the one
    trace without it."""
    texts = F.array(*[F.lit(f"<THINK>{think}</THINK><RESPONSE>{response}</RESPONSE>") for think, response, _ in _KINDS])
    pairs = F.array(*map(F.lit, ("f0_level=low", "voice_stability=unstable", "rhotic_phone_ratio=high")))
    preferred = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("f0_level=low"))).otherwise(F.array(F.lit("voice_stability=unstable")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", texts[(F.col("p_partkey") % 9).cast("int")].alias("text"))
    return rows.select("p_partkey", validation.rubric(F.col("text"), pairs, F.array(F.lit("male"), F.lit("18-25")), preferred).alias("c")).select("p_partkey", "c.*")
