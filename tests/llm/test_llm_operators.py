"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import decontam, langmodel, mixing, pii, quality, simhash, tokencount, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "word " * 60_000, "en", None, None), (4, "a b", "en", "s", 3), (4, "a b", "en", "s", 3), (None, "a b", "en", "s", 3)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "rid", "fp", "token", "row", "_gone", "_keep", "_source", "label", "fold")])


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def no_rows(spark):
    return spark.createDataFrame([], DOCS)


ON_DOCS = {
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels_of(s)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "quality": lambda s, d: quality.score_quality(d, labels_of(s)),
    "langmodel": lambda s, d: langmodel.score(d),
    "pii": lambda s, d: pii.find(d),
    "tokencount": lambda s, d: tokencount.token_counts(d, TOKENIZER),
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_one_row_for_each_row_of_odd_and_empty_tables(spark, name):
    got = ON_DOCS[name](spark, odd(spark)).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, -1, 1, 2, 3, 4, 4]
    assert ON_DOCS[name](spark, no_rows(spark)).collect() == []


FILTERS = {
    "accepted": lambda s, d: quality.accepted(d, labels_of(s)),
    "deduplicated": lambda s, d: simhash.deduplicated(d, shingle=5),
    "decontaminated": lambda s, d: decontam.decontaminated(d, s.createDataFrame([(1, "an item of the benchmark that is long enough"), (None, None), (3, "")], "item_id long, text string")),
    "redacted": lambda s, d: pii.redact_column(d),
    "mixed": lambda s, d: mixing.mixed(d, share=1.0),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns_on_odd_and_empty_tables(spark, name):
    df = odd(spark)
    got = FILTERS[name](spark, df)
    assert got.columns == df.columns and got.count() <= 7
    assert FILTERS[name](spark, no_rows(spark)).collect() == []


def test_top_k_is_exact_with_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, 0.7)) for _ in range(6)]) for i in range(400)]
    rows += [(0, rows[0][1]), (7, rows[7][1]), (401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (500, [float("inf")] * 6), (None, rows[3][1]), (600, [0.1, 0.2])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in (0, 100, 200, 300, 600):
        own = next(v for i, v in good if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert {q for q, found in got.items() if found} == {0, 100, 200, 300}


def plain_fingerprint(text, n=4):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    rng = random.Random(1)
    for _ in range(60):
        t = " ".join(rng.choice(("A", "bÉ", "c\tD", "e f", "g")) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(t, piece=7) == plain_fingerprint(t)


def test_links_meet_every_near_pair(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x, *(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(6))}
    fps |= {0, 1, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4}
    assert got == want and len(want) > 100


def test_anchors_are_not_broadcast(spark):
    # a row is placed at up to 27 anchors, and Spark sizes these as the row
    fps = spark.range(20_000).select(F.xxhash64("id").alias("fp"))
    assert "BroadcastHashJoin" not in simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i, f"a b c d e {i}") for i in range(5)], "doc_id long, text string")
    assert "BroadcastHashJoin" not in simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()


def test_components_reach_the_smallest(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [tuple(sorted(rng.sample(range(40), 2))) for _ in range(30)]
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root


def test_near_duplicates_and_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(400))
    df = docs_of(spark, ["other words entirely, each of them new", base, base + " more", base, "", None, "x"])
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert near[1] == near[2] == near[3] == 1 and near[4] == near[5] == 4 and near[0] == 0
    assert sorted(r.doc_id for r in simhash.deduplicated(df, shingle=5).collect()) == [0, 1, 4, 6]


def test_convolution_covers_the_whole_text(spark):
    rng = random.Random(0)
    filler = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [filler(700) + ("%%###" * 30 if k % 2 else "") + filler(700) for k in range(200)]
    net = quality.ByteConvNet().fit(texts, np.array([k % 2 for k in range(200)]))
    late = filler(5000) + "%%###" * 200
    p = net.score([late, filler(6000), ""])
    assert p[0] > 0.5 > p[1] and np.isfinite(p).all()


def test_urls_meet_the_entries_of_their_day(spark, monkeypatch):
    rng = random.Random(6)
    hosts, day = ["a.com", "x.a.com", "b.org", "b.org/p"], lambda n: f"2024-{1 + n // 28:02}-{1 + n % 28:02}"
    entries = [(rng.choice(hosts), rng.choice(("block", "allow", "remove")), day(rng.randrange(300))) for _ in range(40)] + [(None, "block", day(1)), ("a.com", None, day(2))]
    urls = ["http://x.a.com/p/q?z", "https://u@A.com:80/", "http://b.org/p", "http://b.org", "nothing", None, "http://c.net/"]
    pages = [(i, rng.choice(urls), day(rng.randrange(310)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    listed = spark.createDataFrame(entries, "pattern string, action string, listed_on string").withColumn("listed_on", F.col("listed_on").cast("date"))
    keys = {urls[0]: ["x.a.com", "a.com", "com", "x.a.com/p", "x.a.com/p/q"], urls[1]: ["a.com", "com"], urls[2]: ["b.org", "org", "b.org/p"], urls[3]: ["b.org", "org"]}
    last = {}
    for p, a, d in entries:
        if p and a and a > last.get((p, d), ""):
            last[p, d] = a

    def blocked(url, when):
        best = None
        for k in keys.get(url, []):
            at = max((d for p, d in last if p == k and when and d <= when), default=None)
            if at and last[k, at] in ("block", "allow") and (best is None or len(k) > len(best[0])):
                best = (k, last[k, at])
        return best is not None and best[1] == "block"

    want = {i: blocked(u, d) for i, u, d in pages}
    assert any(want.values())
    # other columns, of any name, are ignored; a list too large to be broadcast gives the same
    clashing = df.withColumns({c: F.lit(1) for c in ("rid", "key", "month", "e", "action", "since", "id")})
    assert {r.page_id: r.blocked for r in urlfilter.evaluate(clashing, listed).collect()} == want
    monkeypatch.setattr(urlfilter, "SMALL_LIST", 0)
    assert {r.page_id: r.blocked for r in urlfilter.evaluate(df, listed).collect()} == want
    none, no_list = df.limit(0), listed.limit(0)
    assert urlfilter.evaluate(none, listed).collect() == [] == urlfilter.evaluate(none, no_list).collect()
    assert {r.blocked for r in urlfilter.evaluate(df, no_list).collect()} == {False}
    assert urlfilter.evaluate(df.unionByName(df), listed).count() == 600


def test_benchmark_passages_are_found_with_edits_and_clean_texts_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(40) for _ in range(12)] + ["short item of ten", ""]
    docs, planted = [], set()
    for i in range(80):
        body = text(rng.choice((30, 300, 3000)))
        if i % 2:
            k = rng.randrange(12)
            copy = list(items[k])
            for _ in range(4):
                copy[rng.randrange(len(copy))] = rng.choice("xyz")
            body = body + ". " + "".join(copy).upper() + " , " + text(20)
            planted.add((i, k))
        docs.append(body)
    df = docs_of(spark, docs)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.matches(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted
    for r in rows:
        assert 0 <= r.start < r.end <= len(docs[r.doc_id])
    assert sorted(r.doc_id for r in decontam.decontaminated(df, bench).collect()) == list(range(0, 80, 2))
    several = decontam.indexes(bench, most=200)
    assert sum(1 for _ in several) > 2


def test_long_texts_are_searched_in_pieces(spark):
    index = decontam.Index([b"the passage that stands in a very long document and has to be found in it all the same, whatever comes before"])
    x = np.frombuffer(b"filler words " * 9000 + b"the passage that stands in a very long document and has to be found in it all the same, whatever comes before".replace(b",", b" ") + b" more" * 9000, np.uint8)
    whole, pieces = index.find(x), index.find_long(x, size=10_000)
    assert len(whole[0]) and {*zip(*(c.tolist() for c in whole))} == {*zip(*(c.tolist() for c in pieces))}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_and_hash(spark):
    rng = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@", "+", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+", "12-34", " ", ".", "é@é.fr", "1.2.3.4.5.6.7.8", "-", "(", "9", "00001.2.3.4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t
    for r in pii.find(docs_of(spark, texts[:200])).collect():
        base = ",".join(f"{[*BASE][k]}:{a}:{b}" for a, k, b in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_trees_add_what_patterns_miss_and_text_is_redacted(spark):
    text = "write to jane.doe [at] example [dot] com or (555) 123-4567 and a@b.org, version 1.20.3"
    base = pii.base_spans(text)
    added = pii.detector().added(text, base)
    assert {text[a:b] for a, _, b in added} >= {"jane.doe [at] example [dot] com", "(555) 123-4567"}
    assert "1.20.3" not in {text[a:b] for a, _, b in added}
    assert pii.redacted(text, base + added) == "write to [EMAIL] or [PHONE] and [EMAIL], version 1.20.3"


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(10)
    bits = ["It's", "they'LL", " ", "\n", "<|endoftext|>", "<|startoftext|>x", "naïve", "é", "ΣΑΣ", "İ", "12345", "½", "!!!", "don't've", " ", "日本語", "😀👍🏽", "a" * 60, "\x00", "ß", "_-_", "ǅ", "​"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["<|endoftext|>" * 3, None, "word " * 3000]
    got = {r.doc_id: r for r in tokencount.token_counts(docs_of(spark, texts), TOKENIZER).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), t


@pytest.mark.parametrize("change", [("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"content": "<x>", "single_word": True, "lstrip": False, "rstrip": False, "normalized": False}])])
def test_tokenizers_with_other_settings_are_refused(tmp_path, change):
    import json

    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    tokencount.check(spec)
    spec[change[0]] = change[1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tokencount.WordPreTokenizer(str(path))
