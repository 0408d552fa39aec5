"""Near-duplicates by the exact Jaccard similarity of word shingles; anchors of SimHash fingerprints and MinHash bands propose the pairs.

Texts with equal sets of shingles are one node. Nodes whose fingerprints differ in ``DISTANCE`` bits or fewer meet at the anchors
of simhash.links(): each is compared with one of them, and later with all that aren't in its component yet. At a similarity of
0.8 fingerprints differ in some 10 bits, more than anchors reach, so bands propose the other pairs. Two nodes share a band of ``ROWS`` minima with the chance J ** ROWS, and one of
all bands with 1 - (1 - J ** ROWS) ** BANDS: at J = 0.8 about 3 pairs of a million have none, above it fewer. Every pair that is
linked has been compared shingle by shingle. Pairs are compared in two turns: first each node with the best connected node (the
hub) of the bucket that it shares most with, then whatever may be similar enough and isn't in one component yet. Two bounds
keep pairs from being made: the shingles that only one of the nodes left has are in no intersection; and two nodes with one hub
share at most the hub's shingles that neither lacks, those both lack being counted by bit maps. So a group of copies takes about
as many comparisons as it has members, and copies with different edits of their own aren't compared with each other.

Spark takes a table with several buckets for each node for as large as the nodes, and a written one for as large as its files, in which keys
that repeat take next to nothing. So tables that grow with the documents are joined by a merge, and with texts or sets of
shingles, which are better left where they are, if sized() finds them large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import simhash
from tracemill.llm._shared import discard, parked, sized, texts_of
from tracemill.llm.simhash import SEED, components, one_of_each

BANDS, ROWS = 24, 4
#: How many bits of two fingerprints may differ at an anchor.
DISTANCE = 4
#: Pairs of the second turn that agree in fewer of the minima's 96 bytes aren't compared: at J = 0.8 the chance of that is below 1e-6.
AGREE = 56
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def hashes(text: str, shingle: int = 5) -> np.ndarray:
    """The XXH64 values of the shingles, repeats included, over words as in simhash.fingerprint(); a text without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, total = b" ".join(words), max(1, len(words) - shingle + 1)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: total - 1]]]
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, ends[-total:])), np.uint64, total)


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """The sorted distinct values."""
    return np.unique(hashes(text, shingle))


def print_of(values: np.ndarray, piece: int = 1 << 16) -> int:
    """simhash.fingerprint() of the text that has these values, as a signed long."""
    fp = simhash.majority((values[k : k + piece] for k in range(0, len(values), piece)), len(values))
    return fp - ((fp >> 63) << 64)


def key_of(held: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(held.tobytes(), SEED)


def minima(held: np.ndarray, piece: int = 1 << 12) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(held), piece):
        h = held[k : k + piece, None] * _ODD + _ADD
        h ^= h >> np.uint64(32)
        least = np.minimum(least, h.min(0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """One signed 64-bit value for each band; equal minima of a band give an equal value."""
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, fp, size, bands, lows): the key of the set of shingles, the text's fingerprint, the set's size, its bands, and a byte
    of each minimum, eight to a long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, size, band, low = [], [], [], [], []
            for text in texts_of(batch):
                values = hashes(text, shingle)
                held = np.unique(values)
                least = minima(held)
                key.append(key_of(held))
                fp.append(print_of(values))
                size.append(len(held))
                band.append(bands(least))
                low.append((least & np.uint64(255)).astype(np.uint8).view(np.int64).tolist())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(key), pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(band, longs), pa.array(low, longs)], ["id", "key", "fp", "size", "bands", "lows"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key string, fp long, size long, bands array<long>, lows array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(key, held): the shingles of the nodes ``wanted`` (key, low), read again from the documents with their smallest ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = wanted.select("low").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(t, shingle) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(h) for h in held]), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))], ["key", "held"])

    found = rows.join(ids, rows["id"].eqNullSafe(ids["low"]), "left_semi").select("text").mapInArrow(run, "key string, held array<long>")
    return found.dropDuplicates(["key"])


def _close(least: tuple[int, int]) -> Column:
    """Whether the sets a and b have a Jaccard similarity of ``least`` (a fraction) or more: both / (a + b - both) >= top / bottom."""
    return F.size(F.array_intersect("a", "b")) * sum(least) >= least[0] * (F.size("a") + F.size("b"))


def _sides(held: DataFrame, u: str, v: str) -> tuple[DataFrame, DataFrame]:
    return held.select(F.col("key").alias(u), F.col("held").alias("a")), held.select(F.col("key").alias(v), F.col("held").alias("b"))


def compared(held: DataFrame, pairs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets in ``held`` (key, held) are similar enough."""
    a, b = _sides(held, "u", "v")
    return parked(sized(pairs).join(a, "u").join(b, "v").filter(_close(least)).select("u", "v"), "links")


def against_hubs(held: DataFrame, star: DataFrame, least: tuple[int, int]) -> DataFrame:
    """``star`` (key, hub) with close, hub_size, lack (how many of the hub's shingles the node lacks) and map0 to map3: 256 bits,
    each set if one of those shingles falls on it."""
    a, b = _sides(held, "key", "hub")
    rows = sized(star).join(a, "key").join(b, "hub").select("key", "hub", _close(least).alias("close"), F.size("b").alias("hub_size"), F.array_except("b", "a").alias("gone"))
    maps = [F.expr(f"aggregate(filter(gone, x -> (x & 192) = {k << 6}), 0L, (m, x) -> m | shiftleft(1L, cast(x & 63 AS int)))").alias(f"map{k}") for k in range(4)]
    return parked(rows.select("key", "hub", "close", "hub_size", F.size("gone").alias("lack"), *maps), "stars")


def anchored(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v), u < v, of the nodes ``each`` (key, fp) by their fingerprints, of which a node stands for all that share its own:
    all pairs within DISTANCE bits; and of each node one, besides the pair with the node that stands for it."""
    prints = parked(each.groupBy("fp").agg(F.min("key").alias("key")), "prints")
    side = lambda c: prints.select(F.col("fp").alias(c), F.col("key").alias("key_" + c)).hint("merge")
    found = simhash.links(prints, DISTANCE).join(side("u"), "u").join(side("v"), "v")
    near = parked(found.select(F.least("key_u", "key_v").alias("u"), F.greatest("key_u", "key_v").alias("v")), "near-prints")
    same = each.select("fp", F.col("key").alias("v")).join(prints.hint("merge"), "fp").filter(F.col("key") < F.col("v")).select(F.col("key").alias("u"), "v")
    tries = parked(near.groupBy("v").agg(F.min("u").alias("u")).select("u", "v").unionByName(same), "tries")
    discard(prints)
    return near, tries


def able(nodes: DataFrame, held: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(key, own): the nodes that may have a link, and how many of their shingles no other node in ``held`` has."""
    one = held.select("key", F.explode("held").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1")
    own = nodes.join(one.groupBy("key").agg(F.count("*").alias("own")), "key", "left").select("key", "size", F.coalesce("own", F.lit(0)).alias("own"))
    # the other set has top / bottom of this one's size at least
    return own.filter((F.col("size") - F.col("own")) * least[1] >= F.col("size") * least[0]).select("key", "own")


def _agree(a: str, b: str) -> Column:
    """How many bytes of the two arrays of longs are equal: those that are 0 in their exclusive or."""
    total = F.lit(BANDS * ROWS)
    for k in range(BANDS * ROWS // 8):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        # the lowest bit of each byte becomes the disjunction of its eight bits
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def near_duplicates(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (the key of its set), component_id (the smallest id reachable by pairs of
    Jaccard similarity ``least`` or more).

    Null and empty texts have the empty set and are equal to each other only. Null ids count as in simhash.near_duplicates().
    """
    found = parked(sketches(docs, shingle, id_col, text_col), "sketches")
    one = found.groupBy("key").agg(F.min("id").alias("low"), F.min("fp").alias("fp"), F.first(F.struct("size", "bands", "lows")).alias("s"))
    each = parked(one.select("key", "low", "fp", "s.*"), "distinct-sets")
    near, tries = anchored(each.filter("size > 0").select("key", "fp"))
    rows = each.filter("size > 0").select("key", F.explode("bands").alias("bucket"))
    many = parked(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    at = parked(rows.join(many.hint("merge"), "bucket"), "members")
    # first each node with one hub: the best connected member of the bucket it shares most with
    degree = at.groupBy("key").agg(F.sum("n").alias("degree"))
    hubs = at.join(degree.hint("merge"), "key").groupBy("bucket").agg(F.max(F.struct("degree", "key")).alias("hub"))
    shared = at.join(hubs.hint("merge"), "bucket").filter(F.col("hub.key") != F.col("key")).groupBy("key", "hub").agg(F.count("*").alias("n"))
    star = shared.groupBy("key").agg(F.max(F.struct("n", "hub")).alias("m")).select("key", F.col("m.hub.key").alias("hub"))
    star = parked(star, "star")
    sets = lambda keys: parked(sets_of(docs, each.join(keys.hint("merge"), "key", "left_semi").select("key", "low"), shingle, id_col, text_col), "sets")
    ends_of = lambda df, *cs: df.select(F.explode(F.array(*cs)).alias("key"))
    tried = sets(ends_of(star, "key", "hub").unionByName(ends_of(tries, "u", "v")).distinct())
    stars = against_hubs(tried, star, least)
    alike = compared(tried, tries, least)
    discard(tried, tries)
    links = stars.filter("close").select(F.least("key", "hub").alias("u"), F.greatest("key", "hub").alias("v")).unionByName(alike).distinct()
    roots = parked(components(links), "roots")

    def open_of(members: DataFrame) -> DataFrame:
        """The members of buckets that hold several components."""
        mixed = members.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("bucket")
        return parked(members.join(mixed.hint("merge"), "bucket"), "open-members")

    # then the members of a bucket that aren't in one component yet
    apart = at.select("bucket", "key").join(roots.hint("merge"), F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    members = parked(apart, "roots-of-members")
    left_over = open_of(members)
    nodes = parked(each.join(left_over.select("key").distinct().hint("merge"), "key", "left_semi").select("key", "size", "bands", "lows"), "nodes")
    name = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias("r" + c)).hint("merge"), c, "left").withColumn("r" + c, F.coalesce("r" + c, c))
    beside = parked(name(name(near, "u"), "v").filter("ru != rv").select("u", "v"), "prints-apart")
    held = sets(nodes.select("key").unionByName(ends_of(beside, "u", "v")).distinct())
    own = parked(able(nodes, held, least), "able")
    # a hub, or a node that no hub was found for, is the hub of its own group and lacks nothing of itself
    group = stars.drop("close").join(stars.select(F.col("hub").alias("key")).distinct().hint("merge"), "key", "left_anti")
    none = {"hub": F.col("key"), "hub_size": F.col("size"), "lack": F.lit(0), **{f"map{k}": F.lit(0).cast("long") for k in range(4)}}
    known = nodes.join(own.hint("merge"), "key").join(group.hint("merge"), "key", "left").withColumns({c: F.coalesce(c, e) for c, e in none.items()}).join(left_over.select("key", "root").distinct().hint("merge"), "key")
    last = parked(known, "left-over")
    side = lambda df, x: df.select(*[F.col(c).alias(c if c == "bucket" else c + x) for c in df.columns])
    top, bottom = least
    enough = lambda most: most * (top + bottom) >= (F.col("size1") + F.col("size2")) * top
    common = lambda x: F.col(f"size{x}") - F.col(f"own{x}")
    union = F.greatest(F.col("size1") + F.col("own2"), F.col("size2") + F.col("own1"))
    most = F.least(common(1), common(2))
    may = (F.col("key1") < F.col("key2")) & (F.col("root1") != F.col("root2")) & enough(most) & (most * bottom >= union * top) & (_agree("lows1", "lows2") >= AGREE)
    bits = lambda *xs: sum(F.bit_count(f(k)) for k in range(4) for f in xs)
    both_lack = bits(lambda k: F.col(f"map{k}1").bitwiseAND(F.col(f"map{k}2"))) + F.least(*[F.col(f"lack{x}") - bits(lambda k, x=x: F.col(f"map{k}{x}")) for x in (1, 2)])
    # the part of the intersection that the hub has, and the part that it hasn't
    within = F.col("hub_size1") - F.col("lack1") - F.col("lack2") + both_lack
    beyond = F.least(*[F.col(f"size{x}") - (F.col(f"hub_size{x}") - F.col(f"lack{x}")) - F.col(f"own{x}") for x in (1, 2)])
    kin = side(last.drop("bands"), "1").withColumnRenamed("hub1", "hub").join(side(last.drop("bands"), "2").withColumnRenamed("hub2", "hub").hint("merge"), "hub").filter(may & enough(within + F.greatest(beyond, F.lit(0))))
    mixed = open_of(left_over.drop("root").join(last.hint("merge"), "key"))
    # of the buckets that a pair shares, one gives it
    here = F.array_min(F.array_intersect("bands1", "bands2")) == F.col("bucket")
    unlike = side(mixed, "1").join(side(mixed, "2").hint("merge"), "bucket").filter((F.col("hub1") != F.col("hub2")) & may & here)
    ends = [F.col(f"key{x}").alias(c) for x, c in ((1, "u"), (2, "v"))]
    pairs = parked(kin.select(*ends).unionByName(unlike.select(*ends)).unionByName(beside).distinct(), "pairs")
    more = compared(held, pairs, least)
    # the new links join components, each of which is one node of a smaller graph
    above = components(name(name(more, "u"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    up = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    lone = up.join(roots.select("root").distinct().hint("merge"), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    roots = parked(roots.join(up.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(lone), "roots")
    named = each.join(roots.hint("merge"), each.key == roots.node, "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    linked = named.join(roots.select("root").distinct().hint("merge"), "root").groupBy("root").agg(F.min("low").alias("component_id"))
    final = parked(named.join(linked.hint("merge"), "root", "left").select("key", F.coalesce("component_id", "low").alias("component_id")), "components")
    discard(each, near, alike, beside, many, at, star, stars, members, left_over, nodes, held, own, last, pairs, more)
    return found.select("id", "key").join(final.hint("merge"), "key").select(F.col("id").alias(id_col), F.col("key").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; see simhash.deduplicated() for repeated and null ids."""
    marks = lambda rows: sketches(rows, shingle, "row", text_col).withColumnRenamed("key", "fingerprint")
    return one_of_each(docs, near_duplicates(docs, shingle, least, id_col, text_col), marks, id_col, text_col)
