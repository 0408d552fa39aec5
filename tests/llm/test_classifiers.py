"""The two classifiers against sums written out, and on held-out labels: recall and precision of the rarer class."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import _labelled, quality, toxicity

SF = "/root/testdata/sf0.1"


def chance(x):
    return 1 / (1 + np.exp(-x))


def mixed_texts(rng, n):
    words = ["insult", "group", "été", "a", "ab", "12", "straße", "under_score", "well-known"]
    return ["", " ", "0"] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def learnt(texts, y):
    return toxicity.FactorizationMachine().fit([toxicity.terms_of(t) for t in texts], np.array(y, float))


def test_scores_equal_the_sum_over_all_pairs():
    rng = random.Random(1)
    texts = mixed_texts(rng, 400)
    machine = learnt(texts, ["insult" in t and "group" in t for t in texts])
    for text, got in zip(texts, machine.scorer()(texts)):
        slots = sorted(machine.slot[h] for h in set(toxicity.terms_of(text).tolist()) if h in machine.slot)
        logit = machine.bias + sum(machine.w[i] for i in slots) + sum(float(machine.v[i] @ machine.v[j]) for i in slots for j in slots if i < j)
        assert abs(got - chance(logit)) < 1e-9


def test_exclusive_or_of_two_words_is_learnt():
    """Neither word tells anything by itself, and no sum of weights can tell the four cases apart."""
    rng = random.Random(0)
    texts, y = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["group"] * b + [rng.choice("klmnop") * 3 for _ in range(5)]))
        y.append(a != b)
    p = learnt(texts, y).scorer()(["insult kkk", "group kkk", "insult group kkk", "kkk"])
    assert min(p[0], p[1]) > 0.9 and max(p[2], p[3]) < 0.1


@pytest.mark.parametrize(("others", "per"), [(300, 60), (2500, 60), (10_000, 200)])
def test_a_pair_is_learnt_whatever_the_vocabulary(others, per):
    """Neither word tells anything alone, and all other words are more frequent or as many as a corpus has."""
    rng = np.random.default_rng(0)
    docs, y, kind = [], [], []
    for _ in range(12_000):
        a, b = rng.random(2) < 0.1
        if rng.random() < 0.1:
            a = b = rng.random() < 0.5
        words = 10 + np.unique((rng.random(per) ** 1.3 * others).astype(np.uint32))
        docs.append(np.concatenate([[1] * int(a), [2] * int(b), words]).astype(np.uint32))
        y.append(float(rng.random() < (0.9 if a and b else 0.011 if a or b else 0.1)))
        kind.append(int(a) + int(b))
    machine, kind = toxicity.FactorizationMachine().fit(docs[:6000], np.array(y[:6000])), np.array(kind[6000:])
    p = toxicity._chance(machine._logits(docs[6000:]))
    assert p[kind == 2].mean() > 0.7 and p[kind < 2].mean() < 0.15 and {1, 2} <= set(machine.slot)


def test_convolution_equals_windows_written_out():
    rng = random.Random(2)
    net = quality.ByteConvNet(filters=3, width=4, chunk=7)
    for text in mixed_texts(rng, 25) + ["x" * 6, "x" * 7, "x" * 8, "long " * 2000]:
        raw = [*text.encode(), *[quality.PAD] * 3] if text else [quality.PAD] * 4
        windows = [[sum(float(net.p["table"][o, raw[i + o], f]) for o in range(4)) for f in range(3)] for i in range(len(raw) - 3)]
        chunks = [[max(0.0, max(w[f] for w in windows[k : k + 7]) + float(net.p["bias"][f])) for f in range(3)] for k in range(0, len(windows), 7)]
        seen = [sum(c[f] for c in chunks) / len(chunks) for f in range(3)] + [max(c[f] for c in chunks) for f in range(3)]
        logit = sum(a * float(b) for a, b in zip(seen, net.p["out"])) + float(net.p["base"][0])
        assert abs(net.score([text])[0] - chance(logit)) < 1e-4


@pytest.mark.parametrize(("column", "rare", "recall", "precision"), [("quality", 0, 0.93, 0.95), ("toxic", 1, 0.85, 0.95)])
def test_held_out_rows_of_the_rarer_class(spark, column, rare, recall, precision):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = (quality.score_quality if column == "quality" else toxicity.score_toxicity)(docs, labels).cache()
    r = scored.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0 <= r[0] and r[1] <= 1 and r[2] == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.select("doc_id", "held_out").limit(300).collect())
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", F.col(column).alias("y")).collect()
    hit, said, true = sum(r.predicted == rare == r.y for r in rows), sum(r.predicted == rare for r in rows), sum(r.y == rare for r in rows)
    assert true > 80 and hit / true >= recall and hit / said >= precision


def test_samples_are_whole_bounded_and_of_documents_that_exist(spark):
    rows = [(i, "w " * (i * 500)) for i in range(60)] + [(3, "zz"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    train = {str(i) for i in range(60) if crc32(str(i).encode()) % 5}
    got = _labelled.sample(docs, labels, "toxic", 1000)
    assert {r.key for r in got.collect()} == train
    assert {r.key: len(r.text) for r in got.collect()} == {k: int(k) * 1000 for k in train}
    assert {r.key: r.y for r in got.collect()} == {k: 0.0 if k == "5" else float(int(k) % 2) for k in train}
    assert _labelled.sample(docs, labels, "toxic", 20).count() == 20
    held, fetched = _labelled.Texts(got, 10**9), _labelled.Texts(got, 300_000, at_once=7)
    order = np.random.default_rng(1).permutation(len(train))
    assert held.texts is not None and fetched.texts is None and len(held) == len(train)
    assert list(held.read(order)) == list(fetched.read(order)) and [len(t) for t, _ in held.read(np.arange(len(train)))] == [int(k) * 1000 for k in held.keys]
