"""Personal data: fixed patterns, and boosted trees that choose among the spans of generous generators."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._boost import BoostedTrees
from tracemill.llm._shared import texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can't start inside a run of digits, as it would have matched from the run's start; saying so keeps it linear.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_some = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]| at \S+ dot ", re.I).search
_not_digit = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind."""
    if not _some(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if _octets(m.group())]
    for m in _card.finditer(text):
        if m.end() - m.start() < 12 or m.end() - m.start() > 37:
            continue
        digits = _not_digit.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _phone.finditer(text):
        if 9 <= len(_not_digit.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


_wordy = re.compile(r"[\w.%+-]{1,64}\s?(?:[\[(]\s?at\s?[\])]|\sat\s)\s?[\w-]{1,63}(?:(?:\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s|\.)[\w-]{1,63}){1,4}", re.I)
_groups = re.compile(r"[0-9]++")
_phones = (
    re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}"),
    re.compile(r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
_quad = re.compile(r"(?=(?<![0-9])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]))")


def candidates(text: str) -> list[Span]:
    """Overlapping spans that might be personal data: spelled-out addresses, every dotted quad, every row of neighbouring
    digit groups, of two digits or more, with 12 to 19 digits in all, and telephone formats with and without a country code."""
    found: set[Span] = set()
    low = text.lower()
    if " dot " in low or "at)" in low or "at]" in low or "at )" in low or "at ]" in low:
        found.update((m.start(), 0, m.end()) for m in _wordy.finditer(text))
    found.update((m.start(1), 1, m.end(1)) for m in _quad.finditer(text))
    groups = [m.span() for m in _groups.finditer(text)]
    for i, (start, _) in enumerate(groups):
        n, last = 0, None
        for a, b in groups[i : i + 19]:
            if last is not None and (a - last > 1 or text[last] not in " -") or b - a < 2:
                break
            n, last = n + b - a, b
            if n > 19:
                break
            if n >= 12:
                found.add((start, 2, b))
    for p in _phones:
        found.update((m.start(), 3, m.end()) for m in p.finditer(text))
    return sorted(found)


#: Common ends of addresses.
_ends = frozenset("com org net edu gov io de fr es it uk us eu ch info biz".split())
#: Words that tell what a number or an address is.
_about = [re.compile(p, re.I).search for p in (r"mail|contact|write|reach", r"\bip\b|host|server|client|addr", r"card|visa|master|amex|pay", r"call|phone|tel|mobile|fax|cell", r"version|release|v\.|section|chapter|license", r"order|invoice|isbn|serial|id\b|no\.|ref|total|sum")]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context."""
    start, kind, end = span
    s = text[start:end]
    groups = _groups.findall(s)
    digits = "".join(groups)
    before, after = text[start - 1 : start], text[end : end + 1]
    far = text[max(0, start - 24) : start]
    sizes = [len(g) for g in groups] or [0]
    octets = [int(g) for g in groups[:4]] if kind == 1 else [0]

    def about(c: str) -> float:
        return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3 if c in ",;:!?)]}\"'" else 4 if c == "." else 5 if c in "+-=/_" else 6

    return [
        kind,
        len(s),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        len(set(digits)),
        len(set(_groups.sub("", s))),
        float(luhn(digits)) if digits else 0,
        float(s.startswith("+")),
        float("(" in s),
        float(s[:1] == "("),
        max(octets),
        sum(len(g) > 1 and g[0] == "0" for g in groups[:4]),
        float(digits[:1] or 0),
        about(before),
        about(after),
        about(text[start - 2 : start - 1]) if start > 1 else 0,
        about(text[end + 1 : end + 2]),
        float(before in " -" and text[max(0, start - 2) : start - 1].isdigit()) if before else 0,
        float(after in " -" and text[end + 1 : end + 2].isdigit()) if after else 0,
        float(len(set(sizes)) == 1),
        float(any(b in s for b in "[(") and kind == 0),
        s.lower().count(" dot ") + s.count("."),
        s.count(" "),
        float(kind == 0 and re.split(r"\W+", s.lower().strip())[-1] in _ends),
        *[float(bool(f(far))) for f in _about],
    ]


def _invented(rng: random.Random) -> tuple[str, set[Span]]:
    """A text of invented words with personal data at known places and things that only look like it."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(1, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        n = rng.choice((16, 16, 16, 16, 15, 19, 13))
        body = rng.choice("3456") + num(n - 2)
        last = next(c for c in "0123456789" if luhn(body + c))
        d = body + (last if valid else str((int(last) + rng.randint(1, 9)) % 10))
        sep = rng.choice(("", "", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    def private() -> tuple[int, str]:
        k = rng.randrange(4)
        if k == 0:
            at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), ("[at]", "[dot]")))
            return 0, f"{word()}{rng.choice(('', '.' + word(), num(2)))}{at}{word()}x{rng.choice(('', dot + word()))}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu'))}"
        if k == 1:
            return 1, ".".join(str(rng.randint(1, 255)) for _ in range(4))
        if k == 2:
            return 2, card(True)
        a, b, c = num(3), num(3), num(4)
        return 3, rng.choice((f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{rng.randint(30, 99)}{num(9)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}"))

    def decoy() -> str:
        return rng.choice((
            lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: ".".join(str(rng.randint(0, 30)) for _ in range(rng.choice((3, 5, 6, 7)))), lambda: f"{rng.randint(256, 999)}.{rng.randint(1, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}",
            lambda: card(False), lambda: num(rng.randint(12, 19)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: " ".join(num(rng.randint(1, 5)) for _ in range(rng.randint(4, 7))), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}", lambda: f"id {num(3)}-{num(3)}-{num(4)}-{num(3)}", lambda: f"{word()}{num(14)}{word()}",
            lambda: f"{word()} at {word()} {word()} dot {word()}", lambda: f"look at the {word()}. {word()}", lambda: f"{word()} at the dot {word()}", lambda: f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"order {num(16)}",
        ))()

    text, spans = "", set()
    hints = (("mail ", "contact: "), ("host ", "ip "), ("card ", "visa: "), ("call ", "tel. "))
    for _ in range(rng.randint(3, 8)):
        text += " ".join(word() for _ in range(rng.randint(0, 6))) + rng.choice((" ", " ", " ", ", ", ". ", "\n", "(", '"', " = "))
        if rng.random() < 0.65:
            for _ in range(rng.choice((1, 1, 1, 2))):
                k, s = private()
                text += rng.choice((*("",) * 6, rng.choice(hints[k])))
                spans.add((len(text), k, len(text) + len(s)))
                text += s + rng.choice((" ", " ", " ", "\n", "- "))
        else:
            text += decoy()
        text += rng.choice((" ", " ", " ", ".", ",", ")", "!!", "###", "%%% ", " "))
    return text, spans


def _clear(taken: list[tuple[int, int]], span: Span) -> bool:
    """Whether a span overlaps none of the disjoint ones in ``taken``, which are sorted."""
    i = bisect_left(taken, (span[2], 0))
    return i == 0 or taken[i - 1][1] <= span[0]


class Detector:
    """Trees, a logistic calibration of their margins, and for each kind the threshold that kept the wanted precision."""

    def __init__(self, texts: int = 2400, precision: float = 0.97, seed: int = 7):
        rng = random.Random(seed)
        x, y = [], []
        for _ in range(texts):
            text, spans = _invented(rng)
            for c in candidates(text):
                x.append(features(text, c))
                y.append(c in spans)
        x, y = np.array(x), np.array(y, float)
        held = np.arange(len(y)) % 3 == 0
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        m, t = self.trees.margin(x[held]), y[held]
        self.slope, self.shift = 1.0, 0.0
        for _ in range(50):  # Newton steps on the log loss
            p = 1 / (1 + np.exp(-(self.slope * m + self.shift)))
            w, r = p * (1 - p) + 1e-9, t - p
            h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            a, b = np.linalg.solve(h, [(r * m).sum(), r.sum()])
            self.slope, self.shift = self.slope + float(a), self.shift + float(b)
        p = self.probability(x[held])
        self.threshold = np.full(len(KINDS), 0.5)
        for k in range(len(KINDS)):
            of = x[held][:, 0] == k
            order = np.argsort(-p[of], kind="stable")
            right = t[of][order].cumsum() / np.arange(1, of.sum() + 1)
            good = np.flatnonzero(right >= precision)
            self.threshold[k] = max(0.5, float(p[of][order][good[-1]])) if len(good) else 1.1

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -30, 30)))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The candidates chosen besides ``base``: likely enough, the likelier and then the longer first, none overlapping."""
        taken: list[tuple[int, int]] = []
        for a, _, b in sorted(base):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        free = [c for c in (candidates(text) if _some(text) else []) if _clear(taken, c)]
        if not free:
            return []
        p = self.probability(np.array([features(text, c) for c in free]))
        out: list[Span] = []
        for _, _, c in sorted((-round(float(q), 6), c[0] - c[2], c) for q, c in zip(p, free) if q >= self.threshold[c[1]]):
            if _clear(taken, c):
                insort(taken, (c[0], c[2]))
                out.append(c)
        return out


@lru_cache(1)
def detector() -> Detector:
    """Trained once on invented texts, always the same."""
    return Detector()


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone (of the fixed patterns), base_sha256, spans (all, as
    kind:start:end in code points, joined by commas), and with ``redact`` the text with each span replaced by [KIND].

    A null text counts as empty: no spans. Other columns are ignored; repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(detector())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = model.value
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, spans, texts = [], [], []
            for text in texts_of(batch):
                base = base_spans(text)
                both = sorted(base + chosen.added(text, base))
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(both))
                if redact:
                    texts.append(redacted(text, both))
            out = [batch.column("id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(texts, pa.string())] if redact else []), names + (["redacted"] if redact else []))

    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema + (", redacted string" if redact else ""))


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with its spans, of which some may overlap, replaced by their kinds in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in its text column replaced; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(detector())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = model.value
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    text = redacted(text, base + chosen.added(text, base))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
