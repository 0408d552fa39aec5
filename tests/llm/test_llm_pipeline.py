"""The corpus pipeline, stage by stage against its operators, and as a whole."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tracemill.llm import pii
from tracemill.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"


def groups(texts):
    """The smallest id that each id reaches by pairs of Jaccard similarity 0.8 or more of five-word shingles, by brute force."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def test_stages_and_their_effects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns and docs.schema == before.schema
        assert docs.count() <= before.count()
        got[name] = (before, docs)
    before, after = got["near_duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups({r.doc_id: r.text for r in before.collect()}).values()))
    before, after = got["personal_data"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        base = pii.base_spans(texts[r.doc_id])
        assert r.text == pii.redacted(texts[r.doc_id], base + pii.detector().added(texts[r.doc_id], base)) and r.n_chars == len(r.text)
        assert not pii.base_spans(r.text)


def test_clean_documents_stay(spark):
    """Documents labelled good, without a near copy or a passage, go through the filtering stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    kept = corpus_pipeline.keep_good(spark, docs, SF)
    n = docs.join(good, "doc_id").count()
    assert kept.join(good, "doc_id").count() >= 0.95 * n


def test_run_is_the_stages_in_order(spark):
    a = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert a.count() > 0 and a.exceptAll(docs.select(a.columns)).count() == 0


def test_queries_are_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries.QUERIES) == list(range(1, 14))
    assert set(llm_queries.ORACLES) <= set(llm_queries.QUERIES)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).select(F.count("*")).first()[0] == 0
