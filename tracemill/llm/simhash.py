"""SimHash near-duplicates by anchors of covering codes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import discard, parked, sized, texts_of

SEED = 42


def fingerprint(text: str, shingle: int = 4, piece: int = 1 << 16) -> int:
    """64 bits: bit j is set if it is set in over half of the XXH64 values of the shingles, repeats included.

    Words stand between ASCII white space, A-Z in lower case. A text of fewer words than a shingle has one shingle, all its
    words; a text without words has the fingerprint 0. Long texts are taken ``piece`` shingles at a time.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, total = b" ".join(words), max(1, len(words) - shingle + 1)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: total - 1]]]
    ends = ends[-total:]
    of = xxhash.xxh64_intdigest
    return majority((np.array([of(joined[a:b], SEED) for a, b in zip(starts[k : k + piece], ends[k : k + piece])], np.uint64) for k in range(0, total, piece)), total)


def majority(pieces: Iterable[np.ndarray], total: int) -> int:
    """The bits that are set in over half of the ``total`` values."""
    ones = np.zeros(64, np.int64)
    for h in pieces:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the id as it is and the fingerprint as a signed long, one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


#: The 64 bits in three blocks (first bit, bits, threshold): fingerprints that differ in 4 bits or fewer differ in at most
#: 1 bit of the first block, or 1 of the second, or 0 of the third, since 2 + 2 + 1 differing bits would be 5.
BLOCKS = ((0, 24, 1), (24, 24, 1), (48, 16, 0))
#: The code of a block with threshold 1: the Hamming code of length 31, whose covering radius is 1. A block's bits are its
#: positions 1 to 24; the others are 0 in every fingerprint.
LENGTH = 31


def _syndromes(x: np.ndarray, bits: int) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for p in range(1, bits + 1):
        s ^= np.where((x >> (p - 1)) & 1, p, 0)
    return s


def anchors(x: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For values of a block: the code word within radius 1 of each (its home), and all code words within radius 2 that can
    be a home, as (positions of the values, code words)."""
    s = _syndromes(x, bits)
    home = np.where(s == 0, x, x ^ (np.int64(1) << np.maximum(s - 1, 0)))
    near = [(np.arange(len(x)), home)]
    for i in range(1, bits + 1):
        j = s ^ i
        # each pair once, and no home has two of the positions that are always 0
        at = np.flatnonzero((s != 0) & (j != 0) & ((j > i) | (j > bits)))
        near.append((at, x[at] ^ (np.int64(1) << (i - 1)) ^ (np.int64(1) << (j[at] - 1))))
    return home, near


def placed(fps: DataFrame, blocks=BLOCKS) -> DataFrame:
    """(anchor, fp, home): each fingerprint at every anchor within covering radius plus threshold; home marks the anchor of each
    block within the covering radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (first, bits, threshold) in enumerate(blocks):
                x = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                home, near = anchors(x, bits) if threshold else (x, [(np.arange(len(x)), x)])
                for at, word in near:
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(word | (np.int64(k) << 40)), pa.array(fp[at].view(np.int64)), pa.array(home[at] == word)], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(fps: DataFrame, distance: int = 4, blocks=BLOCKS) -> DataFrame:
    """(u, v), u < v: the pairs of distinct fingerprints that differ in ``distance`` bits or fewer, each once.

    A fingerprint at home meets all that come to its anchor. Of the blocks in which a pair meets, the first gives it. The
    two sides are joined by the anchor alone, so that skewed anchors can be split. Spark takes a side for as large as ``fps``, of
    which it has up to 27 rows each, so the join is told not to broadcast it.
    """
    if sum(t + 1 for _, _, t in blocks) <= distance:
        raise ValueError("the thresholds of the blocks don't cover the distance")
    at = placed(fps, blocks)
    homes = at.filter("home").select("anchor", F.col("fp").alias("u"))
    visits = at.select("anchor", F.col("fp").alias("v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    first = F.lit(len(blocks))
    for k in reversed(range(len(blocks))):
        start, bits, threshold = blocks[k]
        mask = ((1 << bits) - 1) << start
        mask -= (mask >> 63) << 64
        first = F.when(F.bit_count(differ.bitwiseAND(F.lit(mask))) <= threshold, F.lit(k)).otherwise(first)
    here = F.shiftright(F.col("anchor"), 40) == first
    return homes.join(visits.hint("merge"), "anchor").filter((F.col("u") < F.col("v")) & (F.bit_count(differ) <= distance) & here).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches.

    Large stars and small stars take turns until no edge changes; each turn is written to the shared folder, so
    that neither its lineage nor its size estimates pile up.
    """
    held = parked(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    before = held.select(mark.alias("m")).first()
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, held = held, parked(small.filter(F.col("u") != F.col("v")).distinct(), "links")
        discard(last)
        after = held.select(mark.alias("m")).first()
        if after == before:
            break
        before = after
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Fingerprints link if they differ in ``distance`` bits or fewer; equal ones always do. Null and empty texts have the
    fingerprint 0 and link like any other. A null id is never the smallest; a component of null ids only has the component_id
    null. Repeated rows stay. Other columns are ignored. Only distinct fingerprints are placed and linked. Tables that grow with
    ``docs`` are joined by a merge, as in memory they are several times as large as the files that Spark goes by.
    """
    found = parked(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    each = parked(found.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = components(links(each, distance))
    lows = each.join(roots.hint("merge"), each.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # a fingerprint without links needs no other row
    linked = lows.join(roots.select("root").distinct().hint("merge"), "root")
    named = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    final = parked(lows.join(named, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    return found.join(final.hint("merge"), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows that repeat an id go as copies do if their fingerprints are equal; of one id with several fingerprints each is looked at by
    itself. Rows without an id go if a document with an id is in their component, else stay.
    """
    marks = lambda rows: fingerprints(rows, shingle, "row", text_col).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    return one_of_each(docs, near_duplicates(docs, shingle, distance, id_col, text_col), marks, id_col, text_col)


def one_of_each(docs: DataFrame, near: DataFrame, marks: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that deduplicated() keeps, given ``near`` (id, fingerprint, component_id); ``marks`` gives the (id,
    fingerprint) of rows (row, text)."""
    near = parked(near, "near-duplicates")
    again = parked(near.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).count().filter("count > 1").select("_again"), "repeated-ids")
    # those that go are fewer than those that stay, and few enough to be broadcast if copies are rare
    gone = parked(near.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).unionByName(again.withColumnRenamed("_again", "_gone")).distinct(), "gone")
    named = docs.filter(F.col(id_col).isNotNull())
    first = named.join(sized(gone), named[id_col] == gone["_gone"], "left_anti")
    if not again.isEmpty():
        rows = named.join(sized(again), named[id_col] == again["_again"], "left_semi")
        marked = marks(rows.select(F.struct(*docs.columns).alias("row"), text_col)).select("id", F.col("id")[id_col].alias("_id"), "fingerprint")
        stay = near.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_id"), "fingerprint").distinct()
        one = marked.join(stay, ["_id", "fingerprint"], "left_semi").dropDuplicates(["_id", "fingerprint"])
        first = first.unionByName(one.select("id.*"))
    lost = near.filter(F.col(id_col).isNull())
    if not lost.isEmpty():
        alone = lost.filter(F.col("component_id").isNull()).select(F.col("fingerprint").alias("_alone")).distinct()
        marked = marks(docs.filter(F.col(id_col).isNull()).select(F.struct(*docs.columns).alias("row"), text_col))
        free = marked.join(alone, marked["fingerprint"] == alone["_alone"], "left_semi").select("id.*")
        first = first.unionByName(free)
    return first
