"""The language model against a naive backoff model, whatever is broadcast and whatever is joined."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import langmodel

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w] + ["\n"]


class Naive:
    """Counts in dictionaries; probabilities word by word."""

    def __init__(self, texts, least=2, discount=0.75):
        self.one, self.two, self.history = Counter(), Counter(), Counter()
        for t in texts:
            state = " "
            for w in words_of(t):
                self.one[w] += 1
                self.two[state, w] += 1
                self.history[state] += 1
                state = w
        once, twice = (sum(c == k for c in self.one.values()) for k in (1, 2))
        self.n, self.off, self.discount = sum(self.one.values()), once / (once + 2 * twice) if once and twice else 0.5, discount
        self.kept = {k: c for k, c in self.two.items() if c >= least}
        self.fail = {}
        for (a, _), c in self.kept.items():
            self.fail[a] = self.fail.get(a, 1.0) - (c - discount) / self.history[a]

    def p(self, w, state=None):
        low = (self.one[w] - self.off) / self.n if w in self.one else self.off * len(self.one) / self.n
        if state is None:
            return low
        c = self.kept.get((state, w))
        return ((c - self.discount) / self.history[state] if c else 0.0) + self.fail.get(state, 1.0) * low

    def score(self, text):
        state, total = " ", 0.0
        for w in words_of(text):
            total += math.log10(self.p(w, state))
            state = w
        return total


def compared(rows, texts, naive, held):
    c, n, v = naive.one, naive.n, len(naive.one)
    for i, t in texts.items():
        r, words = rows[i], words_of(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words), sum(c[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r.score, naive.score(t), rel_tol=1e-9)


@pytest.mark.parametrize(("share", "forget"), [(1e-6, 400_000), (1e-3, 50), (1.0, 5000)])
def test_scores_equal_a_naive_model_on_documents(spark, monkeypatch, share, forget):
    monkeypatch.setattr(langmodel, "FORGET", forget)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    naive = Naive([t for i, t in texts.items() if not held(i)])
    rows = {r.doc_id: r for r in langmodel.score(docs, share=share).collect()}
    assert len(rows) == len(texts) and len(naive.kept) > 1000
    compared(rows, texts, naive, held)


def test_scores_equal_a_naive_model_on_odd_texts(spark):
    rng = random.Random(7)
    bits = ("the", "cat", "sat", "On", "É", "é", "mat\n", "\x00", "a b", "x y", "\x1c", "\x85")
    texts = [" ".join(rng.choice((*bits, f"r{rng.randrange(30)}")) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, "", "the cat sat " * 5000]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    naive = Naive([t for i, t in enumerate(texts) if not held(i)])
    for share in (1e-6, 0.02, 1.0):
        compared({r.doc_id: r for r in langmodel.score(df, share=share).collect()}, dict(enumerate(texts)), naive, held)


def test_probabilities_of_a_state_sum_to_one():
    rng = random.Random(1)
    naive = Naive([" ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(30)])
    for state in (" ", "a", "h", "never"):
        assert abs(sum(naive.p(w, state) for w in [*naive.one, "unknown"]) - 1) < 1e-9


def test_keys_are_those_of_the_engine(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 200))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").select(F.xxhash64("a", "b").bitwiseAND(F.lit(-2)).alias("k"))
    assert [r.k for r in df.collect()] == langmodel.pair_keys(a, b).tolist()


def test_sorted_keys_are_found():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        table = langmodel.SortedKeys(keys[np.argsort(keys.view(np.uint64))])
        wanted = np.concatenate([keys, rng.integers(-(1 << 63), (1 << 63) - 1, 500)])
        got = table.find(wanted)
        assert ((got >= 0) == np.isin(wanted, keys)).all() and (table.keys[got[: len(keys)]].view(np.int64) == keys).all()


def test_kept_bigrams_grow_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, many = (langmodel.ngrams(d.select("text")).filter("history <> 0").count() for d in (docs.filter("doc_id % 4 = 0"), docs))
    assert many > 3 * few


def test_no_training_texts(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "some words", "en", "s", 0)], DOCS)
    (r,) = langmodel.score(df).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
