"""Benchmark passages against naive semi-global alignment, at the edges of texts and of tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontam

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fewest(window, text):
    """Fewest edits of ``window`` against any part of ``text``."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        now = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            now[j] = min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1)
        before = now
    return min(before)


def written(rng, items, n):
    """Texts that hold parts of items, cut at either end, with 0 to 8 edits, between other words or alone, some empty."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    other = lambda k: " ".join(word() for _ in range(k))
    docs = []
    for _ in range(n):
        item = rng.choice(items)
        cut = rng.randrange(len(item)) if rng.random() < 0.6 else 0
        body = list(item[cut:] if rng.random() < 0.5 else item[: len(item) - cut])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(min(len(body), 20 if rng.random() < 0.5 else len(body))) if body else 0
            kind = rng.random()
            if body and kind < 0.4:
                body[at] = rng.choice("xyz")
            elif body and kind < 0.7:
                body.pop(at)
            else:
                body.insert(at, rng.choice("xyz"))
        docs.append(rng.choice(("", other(3) + " ", other(30) + " ")) + "".join(body) + rng.choice(("", " " + other(3), " " + other(30))))
        if rng.random() < 0.2:
            docs.append("")
    return docs


@pytest.fixture(scope="module")
def made():
    rng = random.Random(1)
    items = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice((3, 15, 40)))) for _ in range(8)]
    return decontam.Index([decontam.normal(t) for t in items]), written(rng, items, 160)


def test_windows_and_edits_equal_naive_alignment(made):
    index, docs = made
    found, some = index.search(docs), 0
    for text, held in zip(docs, found):
        t, want = decontam.normal(text), {}
        for w in range(len(index.item)):
            edits = fewest(bytes(index.bytes[w][: index.length[w]]), t)
            if edits <= index.edits[w]:
                old = want.get(int(index.item[w]), (0, edits))
                want[int(index.item[w])] = (old[0] + 1, min(old[1], edits))
        assert {k: v[:2] for k, v in held.items()} == want, text
        for k, (_, _, a, b) in held.items():
            some += 1
            assert 0 <= a < b <= len(t)
            # the part between start and end holds the best window itself
            best = min(fewest(bytes(index.bytes[w][: index.length[w]]), t[a:b]) for w in range(len(index.item)) if index.item[w] == k)
            assert best == held[k][1]
    assert some > 40


def test_neighbours_order_and_buffers_change_nothing(made):
    index, docs = made
    found = index.search(docs)
    assert [index.search([t])[0] for t in docs] == found
    assert index.search(docs, size=1) == index.search(docs, size=400) == found
    assert index.search(docs[::-1])[::-1] == found


ITEM = "the passage that stands in the benchmark, word for word, and that nobody should have learnt by heart before the test is taken"


@pytest.mark.parametrize("cut", range(0, 9))
def test_texts_that_begin_or_end_in_mid_passage(spark, cut):
    texts = ["", ITEM[cut:] + " and more words", "", "clean one here, of no benchmark", ITEM[: len(ITEM) - cut], None, "xy" + ITEM[cut:], ""]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).coalesce(1)
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    rows = decontam.matches(df, bench).collect()
    assert {r.doc_id for r in rows} == {1, 4, 6} and all(0 <= r.start < r.end <= len(texts[r.doc_id]) for r in rows)
    assert [r.doc_id for r in decontam.decontaminated(df, bench).orderBy("doc_id").collect()] == [0, 2, 3, 5, 7]


def test_a_quote_of_124_bytes_is_found_wherever_it_begins():
    rng = random.Random(3)
    item = decontam.normal(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(120)))
    index = decontam.Index([item])
    assert all(index.search([item[a : a + 124].decode()])[0] for a in range(len(item) - 124))


def test_odd_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, ITEM, "en", "s", 0), (1, ITEM, "en", "s", 0), (2, "", None, "s", 0), (None, ITEM.upper(), "en", None, 3), (3, "word " * 60_000 + ITEM, "en", "s", 1)]
    odd = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("id", "item_id", "edits", "start", "n_windows")])
    bench = spark.createDataFrame([(5, ITEM, 1), (5, ITEM, 2), (None, None, 3), (None, ITEM, 4), (7, "", 5), (8, "short", 6)], "item_id long, text string, doc_id int")
    got = decontam.matches(odd, bench).collect()
    assert sorted(((r.doc_id or -1, r.item_id or -1, r.edits) for r in got)) == sorted((d, i, 0) for d in (-1, 1, 1, 3) for i in (-1, 5))
    assert decontam.decontaminated(odd, bench).select("text").orderBy("text").collect() == [(None,), ("",)]
    none = spark.createDataFrame([], DOCS)
    assert decontam.matches(none, bench).collect() == [] and decontam.decontaminated(none, bench).collect() == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(odd, empty).collect() == [] and decontam.decontaminated(odd, empty).count() == len(rows)


REPETITIVE = {"laugh": "ha " * 400, "letter": "a" * 1000, "rhyme": "the cat sat on the mat. " * 40}


@pytest.mark.parametrize("name", sorted(REPETITIVE))
def test_repetition_takes_bounded_memory(name):
    """A million characters of what an item repeats; what lies between windows and places is multiplied in steps."""
    import tracemalloc

    index = decontam.Index([decontam.normal(REPETITIVE[name]), b"short item"])
    tracemalloc.start()
    (found,) = index.search([REPETITIVE[name] * (1_000_000 // len(REPETITIVE[name]))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and found[0][1] == 0 and found[0][2] == 0 and found[0][3] > 950_000


def test_many_items_with_one_opening_phrase():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    phrase = "answer the following question in one word "
    items = [phrase + " ".join(rng.choice(words) for _ in range(30)) for _ in range(10_000)] + ["ten of them"]
    index = decontam.Index([decontam.normal(t) for t in items])
    text = " ".join((phrase if i % 20 == 0 else "") + rng.choice(words) for i in range(300))
    clean, leak, short = index.search([text, text + " " + items[77], "only ten of them here"])
    assert clean == {} and sorted(leak) == [77] and sorted(short) == [10_000]
