"""Rules for generated traces, as expressions: blocks, units, traits, response template, label; and the judge's verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.phonology import GROUPS
from tracemill.functions.text import let, strip

#: The patterns and messages of the rules.
BLOCKS = r"(?isU)<THINK>(.*?)</THINK>\s*<RESPONSE>(.*?)</RESPONSE>"
UNITS = r"(?iU)\b(Hz|kHz|ms|sec|seconds)\b"
PAIR = r"(?U)(\w+)=([\w|]+)"
TEMPLATE = r"(?imdU)Based on features such as\s+(.+?),\s+the speaker is most consistent with:\s+(.+?)[\.\s]*$"
SHAPE = "'Based on features such as ..., the speaker is most consistent with: LABEL.'"
NO_BLOCKS = "Format Error: Missing <THINK> or <RESPONSE> tags"
NO_SHAPE = f"Response Template Error: Must match {SHAPE}"
ODD_SHAPE = f"Response Template Error: Structure mismatch. Expected: {SHAPE}"


def think_of(text: Column) -> Column:
    """The first block's thoughts, stripped; empty without blocks."""
    return strip(F.regexp_extract(text, BLOCKS, 1))


def response_of(text: Column) -> Column:
    return strip(F.regexp_extract(text, BLOCKS, 2))


def unit_in(text: Column) -> Column:
    """The first unit of measurement, empty without one."""
    return F.regexp_extract(text, UNITS, 1)


def pairs_in(text: Column) -> Column:
    """Array of ``key=value``, repeats included, in order."""
    return F.regexp_extract_all(text, F.lit(PAIR), F.lit(0))


def traits_of(response: Column) -> Column:
    """What the response names as features; empty if it isn't built as it should be."""
    return F.regexp_extract(response, TEMPLATE, 1)


def label_of(response: Column) -> Column:
    """The label of a response: by the template, else after the last "consistent with:" up to a dot, else null."""

    def of(b: Column) -> Column:
        loose = strip(F.substring_index(strip(F.substring_index(b["response"], "consistent with:", -1)), ".", 1))
        return F.when(b["shaped"] != "", b["shaped"]).when(b["response"].contains("consistent with:"), loose)

    return let(response, lambda r: let(F.struct(r.alias("response"), F.regexp_extract(r, TEMPLATE, 2).alias("shaped")), of))


def clean_label(label: Column) -> Column:
    return strip(F.regexp_replace(label, r"(?U)[^a-zA-Z0-9\s\-/]", ""))


def label_fits(label: Column, candidates: Column) -> Column:
    """Whether a cleaned label equals a candidate, or of more than 3 letters one of the two holds the other; not without candidates."""
    fits = lambda low: lambda c: (c == low) | ((F.length(c) > 3) & low.contains(c)) | ((F.length(low) > 3) & c.contains(low))
    # the label is worked out once and not for every candidate
    return let(F.lower(clean_label(label)), lambda low: F.exists(F.transform(candidates, F.lower), fits(low)))


def valid_pairs(latent: Column, groups: dict[str, list[str]]) -> Column:
    """``key=value`` of the traits in the groups of a latent struct; what stands beside the groups is no trait."""
    return F.array(*[F.concat(F.lit(f"{k}="), latent[g][k].cast("string")) for g, keys in groups.items() for k in keys])


def violations(text: Column, pairs: Column, candidates: Column) -> Column:
    """Array of the rules that a trace breaks, in order: units, traits in the thoughts, template, traits in the response, label.

    Without both blocks the format is the only violation. A response without the template and without "consistent with:" ends
    the list. The label is compared with the candidates, never with the right answer. Null texts count as empty.
    """
    none = F.array().cast("array<string>")
    when = lambda cond, said: F.when(cond, F.array(said)).otherwise(none)
    bad = lambda found, where: F.transform(F.filter(found, lambda p: ~F.array_contains(pairs, p)), lambda p: F.concat(F.lit(f"Invalid trait in {where}: "), p))

    def of_label(label: Column) -> Column:
        listed = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
        return when(~label_fits(label, candidates), F.concat(F.lit("Invalid Label: '"), clean_label(label), F.lit("' (raw: '"), label, F.lit("') not in candidates: ["), listed, F.lit("]")))

    def of_response(response: Column) -> Column:
        def shaped(traits: Column) -> Column:
            named = pairs_in(traits)
            few = when(F.size(named) < 2, F.concat(F.lit("Insufficient traits in RESPONSE: Found "), F.size(named).cast("string"), F.lit(", expected at least 2.")))
            loose = F.when(response.contains("consistent with:"), F.array(F.lit(ODD_SHAPE))).otherwise(F.array(F.lit(NO_SHAPE)))
            return F.when(traits != "", F.concat(few, bad(named, "RESPONSE"))).otherwise(loose)

        return F.concat(let(traits_of(response), shaped), let(label_of(response), lambda label: F.when(label.isNull(), none).otherwise(of_label(label))))

    def of_blocks(b: Column) -> Column:
        think, response = b["think"], b["response"]
        units = let(unit_in(think), lambda u: when(u != "", F.concat(F.lit("Forbidden pattern found: "), u)))
        return F.when((think == "") | (response == ""), F.array(F.lit(NO_BLOCKS))).otherwise(F.concat(units, bad(pairs_in(think), "THINK"), of_response(response)))

    t = F.coalesce(text, F.lit(""))
    return let(F.struct(think_of(t).alias("think"), response_of(t).alias("response")), of_blocks)


#: Words of statistics that a trace mustn't have, and how many traits it names.
STATISTICS = r"(?iU)\b(Hz|kHz|ms|mean|std|median|variance|range)\b|%"
TRAITS = (2, 4)


#: The group of traits that a question prefers, by a word in it, in the order in which the words are tried.
PREFERRED = {"gender": "acoustic", "age": "acoustic", "dialect": "phonology", "ethnicity": "phonology"}


def preferred_pairs(prompt: Column, latent: Column) -> Column:
    """The ``key=value`` of the traits of the group that a question prefers, for rubric(); null for a question that prefers none."""
    found = F.lit(None).cast("array<string>")
    for word, group in reversed(PREFERRED.items()):
        pairs = F.array(*[F.concat(F.lit(f"{t}="), latent[group][t]) for t in GROUPS[group]])
        found = F.when(F.lower(prompt).rlike(rf"\b{word}\b"), F.filter(pairs, lambda p: p.isNotNull())).otherwise(found)
    return found


def rubric(text: Column, pairs: Column, candidates: Column, preferred: Column | None = None) -> Column:
    """Those rules of the judge that need no judgement, as a struct of truths by the judge's names for them.

    Exactly one block of each kind; one sentence after the template; no digit but in a candidate's label or a trait, no unit and no word of
    statistics; a candidate as label; only traits that the recording has; a hedged wording; two to four different traits. With
    ``preferred``, an array of ``key=value``, also whether one of those is named. Null texts count as empty.
    """

    def of_parts(b: Column) -> Column:
        t, response = b["text"], b["response"]
        named = F.array_distinct(pairs_in(F.concat(b["think"], F.lit(" "), response)))
        right = F.filter(named, lambda p: F.array_contains(pairs, p))
        label = F.regexp_extract(response, TEMPLATE, 2)
        bare = F.aggregate(candidates, F.lower(F.regexp_replace(t, PAIR, "")), lambda s, c: F.replace(s, F.lower(c), F.lit("")))
        one = F.lit(True)
        for tag in ("think", "response"):
            one = one & (F.regexp_count(F.lower(t), F.lit(f"<{tag}>")) == 1) & (F.regexp_count(F.lower(t), F.lit(f"</{tag}>")) == 1)
        checks = {
            "format_blocks_present": one & (b["think"] != "") & (response != ""),
            "response_one_sentence": (label != "") & ~label.rlike(r"[.!?]\s+\S"),
            "no_numbers_or_units": ~bare.rlike("[0-9]") & ~bare.rlike(STATISTICS),
            "label_in_candidates": F.coalesce(let(label_of(response), lambda x: label_fits(x, candidates)), F.lit(False)),
            "traits_match_latent_values": F.size(named) == F.size(right),
            "uncertainty_tone_ok": F.lower(response).contains("consistent with") | F.lower(response).contains("suggests"),
            "reasoning_sufficient": F.size(right).between(*TRAITS),
        }
        if preferred is not None:
            checks["preferred_traits"] = F.arrays_overlap(right, preferred)
        return F.struct(*[c.alias(n) for n, c in checks.items()])

    t = F.coalesce(text, F.lit(""))
    return let(F.struct(t.alias("text"), think_of(t).alias("think"), response_of(t).alias("response")), of_parts)


def clean_json(reply: Column) -> Column:
    """A judge's reply without the fence of a json block and without commas before a closing bracket."""
    t = strip(reply)
    inner = strip(F.substring_index(F.substring_index(t, "```json", -1), "```", 1))
    return F.regexp_replace(F.when(t.contains("```"), inner).otherwise(t), r"(?U),\s*([}\]])", "$1")


#: JSON values that count as no; the texts "false" and "0" can't be told from the values and count as no, too.
_NO = ("false", "0", "0.0", "", "[]", "{}", "null")


def soft_verdict(reply: Column) -> Column:
    """(passed, reason) of a judge's reply: all checks hold and there are no violations; an empty object passes. The reason is
    null, the violations, "Soft checks failed", or what can't be parsed."""
    read = F.from_json(clean_json(F.coalesce(reply, F.lit(""))), "checks map<string,string>, violations array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    broken = read.isNull() | read["_bad"].isNotNull() | ~clean_json(F.coalesce(reply, F.lit(""))).startswith("{")
    checks = F.coalesce(F.map_values(read["checks"]), F.array().cast("array<string>"))
    said = F.coalesce(read["violations"], F.array().cast("array<string>"))
    passed = F.forall(checks, lambda c: c.isNotNull() & ~c.isin(*_NO)) & (F.size(said) == 0)
    why = F.when(F.size(said) > 0, F.concat(F.lit("["), F.array_join(said, ", "), F.lit("]"))).otherwise("Soft checks failed")
    lost = F.concat(F.lit("Soft Val JSON Parse Error | Resp: "), F.substring(strip(F.coalesce(reply, F.lit(""))), 1, 50), F.lit("..."))
    return F.struct(F.when(broken, F.lit(False)).otherwise(passed).alias("passed"), F.when(broken, lost).when(~passed, why).alias("reason"))
