"""Repeated byte strings against a set of all strings seen."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tracemill.llm import repeats, suffixes

DOCS = "doc_id long, text string"


def naive(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            window = b[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def compared(df, length):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = suffixes.deduplicated_bytes(df, length).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (*tuple(r)[1:5], bytes(r.kept)) for r in got} == naive(rows, length)


@pytest.mark.parametrize("length", [20, 33, 100])
def test_texts_of_few_letters(spark, length):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab\0c") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 100) :][: rng.randint(0, 200)] for _ in range(rng.randint(0, 5))) for _ in range(60)]
    texts += [None, "", "ab" * 300, "ab" * 300, "a" * 1000, "é" * 200]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[3] + texts[4])], DOCS).selectExpr("*", "1 AS id", "'x' AS th", "2 AS tile")
    compared(df, length)


def test_whole_table(spark):
    compared(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 100)


def test_a_region_of_several_pieces(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    compared(spark.createDataFrame([(1, text), (2, "x" + text[500:] + "y" + text[:700])], DOCS), 100)


def test_rows_that_repeat_an_id(spark):
    text = "".join(random.Random(1).choices("abcd", k=400))
    got = suffixes.deduplicated_bytes(spark.createDataFrame([(1, text), (1, text), (2, text)], DOCS)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 400)]


def test_no_documents(spark):
    assert suffixes.deduplicated_bytes(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("round_", repeats.ROUNDS)
def test_windows_in_slices_are_those_of_the_whole(monkeypatch, round_):
    text = bytes(random.Random(6).choices(b"abc", k=5000))
    seen = lambda: (repeats.ends_of(text, 50, round_).tolist(), [int(x) for w in repeats.slices(text, 50, round_) for x in w.hashes[w.at[: w.windows]]])
    whole = seen()
    monkeypatch.setattr(repeats, "SLICE", 700)
    assert seen() == whole


def test_minimizers_of_chunks_and_windows():
    text = bytes(random.Random(7).choices(b"abcd", k=900))
    (w,) = repeats.slices(text, 40, (32, 0.25))
    parts = [min(range(i, i + w.width), key=lambda j: (int(w.hashes[j]) >> 21, j)) for i in range(len(w.at))]
    assert parts == w.at.tolist()
    a, b = np.array([0, 10, 400]), np.array([10, 400, w.windows])
    places, hashes, sizes = w.minimizers(a, b)
    want = [sorted({parts[t] for t in range(x, y + w.parts - 1)}) for x, y in zip(a.tolist(), b.tolist())]
    assert places.tolist() == [p for chunk in want for p in chunk] and sizes.tolist() == [len(c) for c in want] and (hashes == w.hashes[places].view(np.int64)).all()
    some = np.unique(hashes)[::2]
    assert w.whose(some).tolist() == [all(int(w.hashes[parts[t]].view(np.int64)) in set(some.tolist()) for t in range(i, i + w.parts)) for i in range(w.windows)]


def test_heads_of_texts_together_are_those_of_each():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"abcd", k=n)) for n in (0, 5, 24, 300, 1, 1000)]
    together = suffixes.Heads(texts)
    for i, t in enumerate(texts):
        assert (together.at[together.of == i] - together.starts[i]).tolist() == suffixes.Heads([t]).at.tolist()


def test_the_reduction_moves_blocks_in_bulk(spark, monkeypatch):
    # one row for each minimizer, and several for each of near copies, took more than 4 x input of disk
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh ", k=20_000)) for _ in range(10)]
    texts += [t[:k] + "!" + t[k:] for t in texts[:5] for k in (3000, 9000, 15000)]
    rows = spark.createDataFrame([*enumerate(texts)], "id long, text string").selectExpr("id", "xxhash64(text) AS th", "CAST(text AS BINARY) AS text")
    seen, parked = [], repeats.parked

    def counting(df, name):
        seen.append(parked(df, name))
        seen[-1].rows = seen[-1].count()
        return seen[-1]

    monkeypatch.setattr(repeats, "parked", counting)
    copies, regions = repeats.reduced(rows, 100)
    assert max(t.rows for t in seen) < sum(map(len, texts)) / 500
    # what an edit leaves to the sort is some windows around it
    assert sum(r.b - r.a for r in copies.collect()) > 15 * 19_000 and sum(len(r.text) for r in regions.collect()) < 15 * 2 * 600


def test_little_is_left_around_an_edit(spark):
    # grams of 64 bytes left some 18 windows on each side of an edit, and sorting these took most of the time
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcdefgh ", k=5_000)) for _ in range(10)]
    texts += [t[:k] + "!" + t[k:] for t in texts for k in (1000, 2500, 4000)]
    rows = spark.createDataFrame([*enumerate(texts)], "id long, text string").selectExpr("id", "xxhash64(text) AS th", "CAST(text AS BINARY) AS text")
    regions = [bytes(r.text) for r in repeats.reduced(rows, 100)[1].collect()]
    # an edit has two sides, each in the text and in its copy
    assert sum(len(t) - 99 for t in regions) < 30 * 4 * 6
    assert sum(len(suffixes.Heads([t]).at) for t in regions) < 30 * 4 * 2.5


def test_the_sort_alone(spark, monkeypatch):
    rng = random.Random(11)
    base = ["".join(rng.choice("abc ") for _ in range(600)) for _ in range(6)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 300) :][: rng.randint(0, 300)] for _ in range(6)) for _ in range(30)] + ["ab" * 200, "b" * 500]

    def everything(rows, length):
        return rows.filter("false").selectExpr("id", "th", "0L AS a", "0L AS b"), rows.selectExpr("id", "th", "0L AS at", "text")

    monkeypatch.setattr(suffixes, "reduced", everything)
    compared(spark.createDataFrame([*enumerate(texts)], DOCS), 100)


@pytest.mark.parametrize("gram", [1, 5, 8, 12, 19, 32, 96, 99])
def test_hashes_of_grams_of_any_size(gram):
    x = np.frombuffer(bytes(random.Random(12).choices(b"ab", k=700)) * 2, np.uint8)
    grams = [x[i : i + gram].tobytes() for i in range(len(x) - gram + 1)]
    hashes = repeats.gram_hashes(x, gram).tolist()
    assert len(hashes) == len(grams) and len(set(hashes)) == len(set(grams)) == len(set(zip(grams, hashes)))


def test_blocks_in_order():
    rng = np.random.default_rng(13)
    for n, top in ((0, 1), (1, 1), (500, 2), (500, 400), (500, 1 << 60)):
        x = np.zeros(n, repeats.BLOCK)
        x["gram"], x["bytes"], x["place"] = rng.integers(0, top, n), rng.integers(0, 3, n), rng.permutation(n)
        assert (repeats._sorted(x) == x[np.lexsort((x["place"], x["bytes"], x["gram"]))]).all()
