"""Importance resampling against counts in dictionaries and one sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
from zlib import crc32

from tracemill.llm import resampling

DOCS = "doc_id long, text string"


def features_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def naive(docs, bench, percent=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    found = [(i, *features_of(x)) for i, x in docs]
    for _, _, f in found:
        for b in f:
            s[b] += 1
    for x in bench:
        for b in features_of(x)[1]:
            t[b] += 1
    ss, tt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return {tuple(r[:5]) for r in rows}


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = resampling.resampled(docs, bench).collect()
    assert {tuple(r) for r in got} == naive([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]) and len(got) == docs.count()


def test_odd_texts(spark):
    rng = random.Random(2)
    words = ["the", "Cat", "É", "é", "x" * 70, "y" * 300, "a-b", "3", "\x00", "ß", "漢字", "_"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(None, "the cat " * 40), (1000, None), (1001, ""), (1002, "The, cat. " * 30_000)]
    bench = ["the cat é", None, "", "x" * 70 + " the"]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS id", "2 AS score", "3 AS rank", "4 AS key")
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    for percent in (0, 5, 60, 100):
        assert {tuple(r) for r in resampling.resampled(df, target, percent=percent).collect()} == naive(docs, bench, percent)


def test_ranks_of_equal_and_far_scores(spark):
    rng = random.Random(9)
    scores = [rng.choice([-5, 0, 3, 70_000, -70_000, 1 << 40, -(1 << 40), rng.randint(-(10**6), 10**6)]) for _ in range(3000)]
    got = {r.score: (r.n, r.above) for r in resampling.score_offsets(spark.createDataFrame([(x,) for x in scores], "score long")).collect()}
    assert got == {x: (scores.count(x), sum(y > x for y in scores)) for x in set(scores)}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a " * 30)], DOCS)
    assert resampling.resampled(none, some).collect() == []
    (r,) = resampling.resampled(some, none.select("text"), percent=100).collect()
    assert r.rank == 1 and r.n_features == 87
