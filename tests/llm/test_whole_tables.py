"""Near-duplicate operators end to end: fingerprints and links by brute force, odd tables through the stage that runs."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tracemill.llm import jaccard, simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_all_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, fingerprint(r.text)) for r in docs.collect())
    ids, fps = [i for i, _ in rows], np.array([f for _, f in rows], np.uint64)
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4).tolist():
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    want = {i: (f"{f:016x}", ids[root[k]]) for k, (i, f) in enumerate(rows)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want
    assert len(set(root)) < len(ids)


def test_the_stage_keeps_columns_of_any_name_and_long_texts(spark):
    long = " ".join(f"w{i % 7000}x{i // 7000}" for i in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, "a b c"), (None, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS row", "2 AS id", "3 AS fingerprint", "4 AS component_id", "5 AS low", "array(6) AS bands", "7 AS hub")
    got = jaccard.deduplicated(df)
    assert got.columns == df.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3, 5]
    assert jaccard.deduplicated(df.limit(0)).collect() == []
