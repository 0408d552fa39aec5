"""The near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline

from tracemill.llm import jaccard, simhash
from tracemill.llm._shared import sized

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_drops_what_brute_force_links(spark):
    rng = random.Random(11)
    texts = [None, "", "a b", "A  b", "c"]
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6, 10):
            copy = list(words)
            for _ in range(max(1, edits * len(words) // 250)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    sets = [plain(t) for t in texts]
    root, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                far += bin(simhash.fingerprint(texts[i] or "", 5) ^ simhash.fingerprint(texts[j] or "", 5)).count("1") > 4
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == dict(enumerate(root))
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect())
    assert kept == sorted(set(root)) and far > 50


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, long), (None, "alone here"), (3, long), (3, long), (4, long + " more"), (5, "other"), (7, "two texts"), (7, "of one id"), (8, "of one id"), (9, long), (9, "not a copy")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in jaccard.deduplicated(df).collect()]
    assert sorted(kept, key=str) == sorted([(None, "alone here"), (3, long), (5, "other"), (7, "two texts"), (7, "of one id"), (9, "not a copy")], key=str)


def test_fingerprints_alone_propose_what_they_reach(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words[:150] + ["x"] + words[151:]), " ".join(words + ["y"]), " ".join(words[::-1])]
    # bands that only texts with equal minima share
    monkeypatch.setattr(jaccard, "bands", lambda least: [hash((k, least.tobytes())) for k in range(24)])
    fps = [simhash.fingerprint(t, 5) for t in texts]
    sets = [plain(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for i, j in near:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == dict(enumerate(root))
    assert len(near) > 12
    assert [jaccard.print_of(jaccard.hashes(t)) % (1 << 64) for t in texts] == fps


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, parked = {}, jaccard.parked

    def spied(df, name):
        plans[name] = plans.get(name, "") + plan_of(df)
        return parked(df, name)

    monkeypatch.setattr(jaccard, "parked", spied)
    monkeypatch.setattr(simhash, "parked", spied)
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(words[:30] + [f"x{i}"] + words[30:]), "en", "s", 0) for i in range(20)], DOCS)
    plan = plan_of(jaccard.near_duplicates(df))
    grow = ("near-prints", "tries", "members", "star", "roots-of-members", "open-members", "nodes", "prints-apart", "left-over", "pairs", "roots", "components")
    assert [name for name in grow if "BroadcastHashJoin" in plans[name]] == [] and "BroadcastHashJoin" not in plan
    # with texts, ids are joined by their number
    jaccard.deduplicated(df)
    ids = parked(spark.range(100), "ids")
    plan = lambda most: plan_of(df.join(sized(ids, most), df["doc_id"] == ids["id"], "left_anti"))
    assert "gone" in plans and "BroadcastHashJoin" in plan(100) and "BroadcastHashJoin" not in plan(99)
