"""Places of texts that may repeat elsewhere: an exact reduction before suffixes are sorted.

A window's minimizer is the gram with the least hash in it. Neighbouring windows with one minimizer form a block, which its bytes
decide, and equal windows have equal minimizers at the same distance. So of blocks that have both their minimizer and their
bytes in common the first one stands for all, and the windows of the others are repeats; and a block whose minimizer isn't
that of a block with other bytes repeats nothing more. What remains are blocks that share a minimizer but not their bytes. A second
round, with longer grams, does the same with these.

Blocks are dealt by the hash of their minimizers, many in a row, and each task first settles those among its own texts, so that no
key, however frequent, comes more than once from each group of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import bytes_of, discard, parked

#: Bytes of a gram, at most.
GRAM = 32
#: The rounds of the reduction: how many places (a power of two) have a chunk's end among them, on average, how many of a window's grams a
#: minimizer is the least of, and how much longer than GRAM a gram is, though shorter than a window. The first round is for all texts;
#: the second, for what is left, asks for nearly a window's bytes in common, so that little stays around the ends of what repeats.
ROUNDS = ((1024, 1.0, 1), (32, 1.0, 3))
#: Windows that are looked at together, so that their hashes stay in a core's cache.
SLICE = 1 << 16
#: Bytes of texts whose blocks are settled together; places of a tile, as a power of two, and the most windows of a piece of it.
GROUP, TEXT_BITS, TEXT_PIECE = 1 << 24, 22, 1 << 20
_BASE, _MIX, _ALL, _PLACE = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), (1 << 64) - 1, np.uint64((1 << 21) - 1)


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each byte on."""
    if gram < 8:
        h, base, step = x.astype(np.uint64), _BASE, 1
    else:
        h, base, step = np.ndarray(max(0, len(x) - 7), "<u8", np.ascontiguousarray(x), strides=(1,)) * np.uint64(_BASE), _BASE, 8
        h ^= h >> np.uint64(32)
    while step * 2 <= gram:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base & _ALL
        step *= 2
    h ^= h >> np.uint64(31)
    if step < gram:  # not a power of two: two that overlap
        h = h[: step - gram] * np.uint64(base) + h[gram - step :]
        h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """The least (np.minimum) or greatest (np.maximum) of every ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = least(x[:-step], x[step:])
        step *= 2
    return least(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class Windows:
    """The windows of a text that start at ``first`` .. ``last`` - 1, the minimizers of their parts, and the places where chunks begin.

    A part of a window is ``width`` neighbouring grams; with the greatest width a window is its own only part.
    """

    def __init__(self, text: bytes, length: int, first: int, last: int, round_: tuple):
        (cut, share), longer = round_[:2], (*round_, 1)[2]
        least, before = min(GRAM, 1 << (length.bit_length() - 2)), int(first > 0)
        gram = min(least * longer, max(least, length - 1))
        h = gram_hashes(np.frombuffer(text, np.uint8, last - first + length - 1 + before, first - before), gram)
        self.first, self.hashes, self.windows = first, h[before:], last - first
        self.width = max(1, int((length - gram + 1) * share))
        self.parts = length - gram + 2 - self.width
        # the place stands in the low bits, so that of equal hashes (but for these bits) the first one counts
        keys = (self.hashes & ~_PLACE) | np.arange(len(self.hashes), dtype=np.uint64)
        self.at = (sliding(keys, self.width, np.minimum) & _PLACE).astype(np.int64)
        self.starts, self.before, self.cut = h[: last - first + before], before, cut

    @cached_property
    def cuts(self) -> np.ndarray:
        # rounds look at other bits, so that the ends of one are none of the other
        ends = ((self.starts >> np.uint64(self.cut.bit_length())) & np.uint64(self.cut - 1)) == 0
        ends[1:] &= self.starts[1:] != self.starts[:-1]  # a run of one gram isn't cut at every byte
        return self.first + np.flatnonzero(ends[self.before :])

    def blocks(self, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks among ``valid`` windows: where they begin, how many windows they have, and their minimizers' hashes."""
        turn = np.append(True, self.at[1:] != self.at[:-1])
        turn[1:] |= valid[1:] != valid[:-1]
        begin = np.flatnonzero(turn)
        size, mine = np.diff(begin, append=self.windows), valid[begin]
        return self.first + begin[mine], size[mine], self.hashes[self.at[begin[mine]]]

    def minimizers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each range of windows a .. b - 1 the grams that are least in a part of one of them: their places and hashes, one range after
        another, and how many each has."""
        begin, size = a - self.first, b - a + self.parts - 1
        offsets = np.cumsum(size) - size
        at = self.at[np.repeat(begin - offsets, size) + np.arange(size.sum())]
        new = np.append(True, at[1:] != at[:-1])
        new[offsets] = True
        found = at[new]
        return found + self.first, self.hashes[found].view(np.int64), np.add.reduceat(new.astype(np.int64), offsets)

    def whose(self, hashes: np.ndarray) -> np.ndarray:
        """Which windows have minimizers among ``hashes`` only."""
        odd = ~np.isin(self.hashes[self.at].view(np.int64), hashes)
        count = np.append(0, np.cumsum(odd))
        return count[self.parts :] == count[: self.windows]


def slices(text: bytes, length: int, round_: tuple = ROUNDS[0]) -> Iterator[Windows]:
    windows = len(text) - length + 1
    for first in range(0, max(0, windows), SLICE):
        yield Windows(text, length, first, min(windows, first + SLICE), round_)


def ends_of(text: bytes, length: int, round_: tuple = ROUNDS[0]) -> np.ndarray:
    """Where the chunks of a text begin, and where the last one ends: behind the last window."""
    windows = len(text) - length + 1
    return np.unique(np.concatenate([[0], *[w.cuts for w in slices(text, length, round_)], [windows]])) if windows > 0 else np.zeros(1, np.int64)


KEYS = ("id", "th")
#: A block as it is dealt: the hash of its minimizer, that of its bytes, its place and its windows; and what comes back to its tile.
BLOCK = np.dtype([("gram", "<u8"), ("bytes", "<u8"), ("place", "<i8"), ("n", "<u4")])
MARK = np.dtype([("at", "<u4"), ("n", "<i4")])


def tiled(rows: DataFrame, length: int, bits: int, piece: int) -> DataFrame:
    """(tile, base, n, id, th, a, text) of (id, th, at, text), which stands from byte ``at`` of its document on: texts cut in pieces of at
    most ``piece`` windows, laid out in tiles of 2 ** ``bits`` places in the order of (id, th, a). Rows that repeat (id, th, at) count once."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, base, last = TaskContext.get().partitionId() << 24, 0, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (*KEYS, "at")))
            out, row, texts = [], [], []
            for i, (key, text) in enumerate(zip(keys, bytes_of(batch))):
                if key == last:
                    continue
                last = key
                for s in range(0, len(text) - length + 1, piece):
                    part = text[s : s + piece + length - 1]
                    if base + len(part) > 1 << bits:
                        tile, base = tile + 1, 0
                    out.append((tile, base, len(part) - length + 1, key[2] + s))
                    row.append(i)
                    texts.append(part)
                    base += len(part)
            if row:
                numbers = np.array(out, np.int64)
                ids = [batch.column(c).take(pa.array(row)) for c in KEYS]
                yield pa.RecordBatch.from_arrays([*(pa.array(numbers[:, k]) for k in range(3)), *ids, pa.array(numbers[:, 3]), pa.array(texts, pa.binary())], ["tile", "base", "n", *KEYS, "a", "text"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(*KEYS, "at", "text").repartitionByRange(n, *KEYS, "at").sortWithinPartitions(*KEYS, "at")
    return parked(ranged.mapInArrow(lay, f"tile long, base long, n long, id {rows.schema['id'].dataType.simpleString()}, th long, a long, text binary"), "tiles")


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Some of a batch's texts one after another, where each begins and ends there, and the place of its first byte less that."""
    sizes = pc.binary_length(batch.column("text")).to_numpy()
    places = (batch.column("tile").to_numpy() << TEXT_BITS) + batch.column("base").to_numpy()
    which = np.cumsum(sizes) // GROUP
    for g in np.unique(which):
        lo, hi = np.searchsorted(which, [g, g + 1])
        ends = np.cumsum(sizes[lo:hi], dtype=np.int64)
        yield b"".join(batch.column("text").slice(lo, hi - lo).to_pylist()), np.append(0, ends), places[lo:hi] - np.append(0, ends[:-1])


def blocks(text: bytes, bounds: np.ndarray, shifts: np.ndarray, length: int, round_: tuple) -> np.ndarray:
    """The blocks of texts that stand one after another, in the order of their minimizers, bytes and places."""
    turns = np.zeros(len(text) + 1, np.int8)
    np.add.at(turns, bounds[:-1], 1)
    np.add.at(turns, bounds[1:] - length + 1, -1)
    valid = np.cumsum(turns, dtype=np.int8) > 0
    found = [w.blocks(valid[w.first : w.first + w.windows]) for w in slices(text, length, round_)]
    if not found:
        return np.zeros(0, BLOCK)
    at, n, grams = (np.concatenate(x) for x in zip(*found))
    out = np.zeros(len(at), BLOCK)
    digest = xxhash.xxh3_64_intdigest
    cells = map(text.__getitem__, map(slice, at.tolist(), (at + n + length - 1).tolist()))
    out["bytes"] = np.fromiter(map(digest, cells), np.uint64, len(at))
    out["gram"], out["n"] = grams, n
    out["place"] = at + shifts[np.searchsorted(bounds, at, "right") - 1]
    return _sorted(out)


def _sorted(x: np.ndarray) -> np.ndarray:
    """Blocks in the order of their minimizers, bytes and places; most minimizers have one block, so only the others' are compared further."""
    order = np.argsort(np.ascontiguousarray(x["gram"]))
    gram = x["gram"][order]
    same = gram[1:] == gram[:-1]
    several = order[many := np.flatnonzero((np.append(same, False) | np.append(False, same))[: len(x)])]
    y = x[several]
    order[many] = several[np.lexsort((y["place"], y["bytes"], y["gram"]))]
    return x.take(order)


def _firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of sorted blocks have another minimizer than the one before, and which have another one or other bytes."""
    gram = np.append(True, x["gram"][1:] != x["gram"][:-1])[: len(x)]
    return gram, gram | np.append(True, x["bytes"][1:] != x["bytes"][:-1])[: len(x)]


def _dealt(tiles: DataFrame, length: int, round_: tuple, buckets: int) -> DataFrame:
    """(bucket, blocks, gone): the first blocks of their kind in each group of texts, and the blocks that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, bounds, shifts in _groups(batch):
                found = blocks(text, bounds, shifts, length, round_)
                if not len(found):
                    continue
                _, first = _firsts(found)
                # sorted by minimizers, so each bucket is a range of them
                cuts = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
                edges = np.append(np.searchsorted(found["gram"], cuts), len(found))
                parts = [(found[a:b], first[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                kept, gone = [x[f].tobytes() for x, f in parts], [x[~f].tobytes() for x, f in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(kept, pa.binary()), pa.array(gone, pa.binary())], ["bucket", "blocks", "gone"])

    return tiles.select("tile", "base", "text").mapInArrow(run, "bucket int, blocks binary, gone binary")


def _settled(table: pa.Table) -> pa.Table:
    """(tile, marks): what a bucket's blocks come to; the windows of a copy are counted below zero."""
    x = _sorted(np.frombuffer(b"".join(table.column("blocks").to_pylist()), BLOCK))
    gone = np.frombuffer(b"".join(table.column("gone").to_pylist()), BLOCK)
    gram, kind = _firsts(x)
    of = np.cumsum(gram) - 1
    shared = np.bincount(of, kind)[of] > 1 if len(x) else np.zeros(0, bool)
    rest, copies = x[kind & shared], np.concatenate([x[~kind], gone])
    place = np.concatenate([rest["place"], copies["place"]])
    n = np.concatenate([rest["n"].astype(np.int32), -copies["n"].astype(np.int32)])
    order = np.argsort(place)
    tile, marks = place[order] >> TEXT_BITS, np.zeros(len(place), MARK)
    marks["at"], marks["n"] = place[order] & ((1 << TEXT_BITS) - 1), n[order]
    begin = np.flatnonzero(np.diff(tile, prepend=-1))
    cells = [marks[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(tile)))]
    return pa.table([pa.array(tile[begin]), pa.array(cells, pa.binary())], ["tile", "marks"])


def runs(marks: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a tile's marked windows: which of the pieces from ``base`` on has each, and where it begins and ends in the tile. Windows of
    two pieces never touch."""
    turns, order = np.flatnonzero(np.diff(marks, prepend=np.int8(0), append=np.int8(0))), np.argsort(base)
    begin, end = turns[::2], turns[1::2]
    return order[np.searchsorted(base[order], begin, "right") - 1], begin, end


def _fetched(left: pa.Table, right: pa.Table, length: int) -> pa.Table:
    """(id, th, at, b, text) of a tile: runs of copies, without a text, and regions."""
    m = np.frombuffer(b"".join(right.column("marks").to_pylist()), MARK)
    at, size = m["at"].astype(np.int64), np.abs(m["n"].astype(np.int64))
    base, first = left.column("base").to_numpy(), left.column("a").to_numpy()
    sizes = pc.binary_length(left.column("text")).to_numpy().astype(np.int64)
    texts, stands = b"".join(left.column("text").to_pylist()), np.cumsum(sizes) - sizes
    found, cells = [], []
    for which in (m["n"] < 0, m["n"] > 0):
        turns = np.zeros((1 << TEXT_BITS) + 1, np.int8)
        np.add.at(turns, at[which], 1)
        np.add.at(turns, at[which] + size[which], -1)
        found.append(runs(np.cumsum(turns, dtype=np.int8), base))
        row, a, b = found[-1]
        i, j = (stands - base)[row] + a, (stands - base)[row] + b + length - 1
        cells += [texts[x:y] for x, y in zip(i.tolist(), j.tolist())] if len(found) > 1 else [None] * len(row)
    row, begin, end = (np.concatenate(x) for x in zip(*found))
    ids = [left.column(c).take(pa.array(row, pa.int64())) for c in KEYS]
    from_tile = (first - base)[row]
    return pa.table([*ids, pa.array(begin + from_tile), pa.array(end + from_tile), pa.array(cells, pa.binary())], [*KEYS, "at", "b", "text"])


def reduced(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(copies, regions) of (id, th, text). Copies are runs of windows a .. b - 1 that an earlier place stands for, as (id, th, a, b).
    Regions (id, th, at, text) are runs of windows from byte ``at`` of the document on that share their minimizers with others.

    ``th`` tells apart rows that repeat an id with another text; rows that repeat both count once.
    """
    regions, copies = rows.withColumn("at", F.lit(0).cast("long")), None
    for round_ in ROUNDS:
        found = _reduced(regions, length, round_)
        more, regions = found.filter("text IS NULL").select(*KEYS, F.col("at").alias("a"), "b"), found.filter("text IS NOT NULL").drop("b")
        copies = more if copies is None else copies.unionByName(more)
    return copies, regions


def _reduced(rows: DataFrame, length: int, round_: tuple) -> DataFrame:
    tiles = tiled(rows, length, TEXT_BITS, TEXT_PIECE)
    # buckets grow in number with the partitions; each is a range of hashes
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = parked(_dealt(tiles, length, round_, buckets).groupBy("bucket").applyInArrow(_settled, "tile long, marks binary"), "marks")
    kind = rows.schema["id"].dataType.simpleString()
    met = tiles.groupBy("tile").cogroup(marks.groupBy("tile"))
    found = parked(met.applyInArrow(lambda left, right: _fetched(left, right, length), f"id {kind}, th long, at long, b long, text binary"), "regions")
    discard(tiles, marks)
    return found
