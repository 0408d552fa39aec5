"""The threshold algorithm against full sorting: when it stops, and odd tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import topk


def naive(ids, vectors, query_id, q, k):
    scores = sorted((-int(v @ q), int(i)) for i, v in zip(ids, vectors) if i != query_id)
    return scores[:k]


@pytest.mark.parametrize("kind", ["sparse", "skewed", "dense"])
def test_lists_give_what_sorting_gives_and_stop_where_they_can(kind):
    rng = np.random.default_rng(4)
    n, d, k = 4000, 24, 10
    if kind == "sparse":  # few dimensions each, as weights of terms
        v = (rng.integers(1, 900, (n, d)) * (rng.random((n, d)) < 0.1)).astype(np.int64)
    elif kind == "skewed":  # one dimension decides
        v = rng.integers(-4, 5, (n, d))
        v[:, 0] = rng.integers(0, 5000, n)
    else:
        v = rng.integers(-300, 300, (n, d))
    lists = topk.SortedLists(np.arange(n), v)
    for i in range(40):
        for floor in (None, -naive(range(n), v, i, v[i], k)[-1][0]):
            assert lists.improve(i, v[i], [], k, floor) == naive(range(n), v, i, v[i], k)
    share = lists.scored / (80 * n)
    assert share < 0.5 if kind != "dense" else share == 1.0


def test_queries_of_one_id_repeats_and_passes(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0])] + [(i, [math.sin(i), math.cos(i)]) for i in range(1, 250)] + [(5, [math.sin(5), math.cos(5)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "score", "number", "query_id")})
    one, many = ([tuple(r) for r in topk.top_k(df, queries_at_once=q).orderBy("query_id", "rank", "vec_id").collect()] for q in (1000, 2))
    assert one == many
    assert [r[0] for r in one].count(0) == 20 and [r[0] for r in one].count(100) == 10
    ints = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows}
    for q in [v for i, v in ints if i == 0]:
        best = sorted((-(q[0] * math.floor(1024 * v[0]) + q[1] * math.floor(1024 * v[1])), i) for i, v in rows if i != 0)[:10]
        assert {(0, k + 1, i, -s) for k, (s, i) in enumerate(best)} <= set(one)


def test_empty_tables_and_no_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(none).collect() == []
    lone = spark.createDataFrame([(100, [1.0]), (None, [1.0]), (101, None), (7, [float("nan")])], "vec_id long, embedding array<double>")
    assert topk.top_k(lone).collect() == []
    assert topk.top_k(lone.filter("vec_id = 7")).collect() == []
