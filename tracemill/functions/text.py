"""Column helpers for texts: stripping, labels, tags, templates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that say the opposite of each other, in the reference answer and in the prediction.
OPPOSITES = (
    ("high rhoticity", "low rhoticity"),
    ("low rhoticity", "high rhoticity"),
    ("high pitch", "low pitch"),
    ("low pitch", "high pitch"),
    ("high vowel reduction", "low vowel reduction"),
    ("low vowel reduction", "high vowel reduction"),
)
#: Phrases that no annotation has, and what is said of them.
INVENTED = (
    (("biracial",), "Mentions 'biracial' (not annotated in ground-truth labels)."),
    (("jianghuai mandarin", "hefei dialect"), "Mentions non-existent dialect label (e.g., Jianghuai Mandarin)."),
)
CLOSING = "</RESPONSE>"
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() knows blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def last_line(c: Column) -> Column:
    return F.element_at(F.split(c, _LINE), -1)


def extract_label(text: Column) -> Column:
    """What follows the last "most consistent with:", else the last " is " of the last line, else that line; without outer white
    space, then without outer dots, in lower case. Null for texts that are null or blank."""

    def label(t: Column) -> Column:
        part = F.when(F.lower(t).contains("most consistent with:"), F.regexp_extract(t, r"(?is)^.*most consistent with:(.*)$", 1)).otherwise(let(strip(last_line(t)), after_is))
        return F.when(t != "", F.lower(F.regexp_replace(strip(part), r"^\.+|\.+$", "")))

    def after_is(line: Column) -> Column:
        return F.when(F.lower(line).contains(" is "), F.regexp_extract(line, r"(?is)^.* is (.*)$", 1)).otherwise(line)

    return let(strip(text), label)


def final_answer_tail(text: Column, tag: str = "<FINAL_ANSWER>") -> Column:
    """What follows the last tag, the whole text without one; a closing tag stays in."""
    return strip(F.substring_index(text, tag, -1))


def ensure_closing_tag(text: Column, tag: str = CLOSING) -> Column:
    t = strip(text)
    return F.when(t.endswith(tag), t).otherwise(F.concat(t, F.lit("\n" + tag)))


def verdict(text: Column) -> Column:
    """True with "pass" and no "fail", false with "fail" and no "pass", else null."""
    low = F.lower(text)
    good, bad = low.contains("pass"), low.contains("fail")
    return F.when(good & ~bad, F.lit(True)).when(bad & ~good, F.lit(False))


def reasoning_issues(truth: Column, predicted: Column) -> Column:
    """Array of what is questionable in a prediction: opposite descriptions, then invented attributes."""
    t, p = F.lower(F.coalesce(truth, F.lit(""))), F.lower(F.coalesce(predicted, F.lit("")))
    found = [F.when(t.contains(a) & p.contains(b), F.lit(f"GT has '{a}' but prediction says '{b}'")) for a, b in OPPOSITES]
    for words, said in INVENTED:
        any_of = p.contains(words[0])
        for w in words[1:]:
            any_of = any_of | p.contains(w)
        found.append(F.when(any_of, F.lit(said)))
    return F.array_compact(F.array(*found))


def fill_template(template: str | Column, values: Mapping[str, Column]) -> Column:
    """``template`` with each key replaced as it stands, in order; later keys also meet what earlier ones put in."""
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit(key), F.coalesce(value.cast("string"), F.lit("")))
    return out


def feature_block(features: Column, digits: int | None = None) -> Column:
    """A map as lines ``  'key': value,`` in braces, by key; with ``digits`` the values are formatted to so many places."""
    show = (lambda v: F.format_string(f"%.{digits}f", v)) if digits is not None else (lambda v: v.cast("string"))
    lines = F.transform(F.array_sort(F.map_entries(features)), lambda e: F.concat(F.lit("  '"), e["key"], F.lit("': "), show(e["value"]), F.lit(",")))
    return F.concat(F.lit("{\n"), F.array_join(lines, "\n"), F.lit("\n}"))


def phoneme_block(phones: Column, digits: int = 2) -> Column:
    """An array of (phoneme, duration) as ``[('a', 0.10), ...]``."""
    pairs = F.transform(phones, lambda p: F.concat(F.lit("('"), p["phoneme"], F.lit("', "), F.format_string(f"%.{digits}f", p["duration"]), F.lit(")")))
    return F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]"))


def choices(candidates: Column) -> Column:
    return F.array_join(candidates, ", ")


def chat_turns(prompt: Column, answer: Column | None = None) -> Column:
    """Array of (role, content): the user's turn and, if there is an answer, the assistant's."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = [turn("user", prompt)] + ([turn("assistant", answer)] if answer is not None else [])
    return F.array(*turns)


def one_of(text: Column, values: Sequence[str]) -> Column:
    """Whether the stripped text in lower case is one of ``values``; null counts as the empty text."""
    return F.lower(strip(F.coalesce(text, F.lit("")))).isin(*values)
