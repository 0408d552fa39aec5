"""Repeated byte strings by a distributed suffix array, built with a difference cover.

Regions of texts (from repeats.py) are read as strings of phrases: a phrase begins at a byte whose gram has the least hash
within REACH bytes on both sides, and goes on to the bytes that decide where the next one begins, so that no phrase begins
another one and the order of phrases is that of their bytes. Then, as in the skew algorithm:

1. phrases are sorted and named, and a region is the string of its phrases' names;
2. the triples of the positions that are 1 or 2 modulo 3 are sorted, and equal triples get one name;
3. unless these names cover a window or are all different, the string of names is sorted in the same way;
4. of the other positions each is placed among those that are 1 modulo 3 by (name, rank of the next position), and among
   those that are 2 modulo 3 by (name, next name, rank of the position after it); the two places add up;
5. every window is placed by its bytes up to the end of the phrase's head that it meets first, and the rank from there on;
6. of neighbours in this order those that begin with the same ``length`` bytes form a class, whose first place is kept.

Order only matters for ``length`` bytes: ties beyond them are broken anyhow, which leaves each class together. Every sort is a
range partition by (key, position), so that no key, however frequent, has to fit one task; what passes between ranges is a row
of sums and the keys at their ends. Neighbouring positions meet by tile, a group of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import bytes_of, discard, parked
from tracemill.llm.repeats import KEYS, gram_hashes, reduced, runs, sliding, tiled

#: Positions of a tile, as a power of two; the most windows of a piece.
TILE_BITS, PIECE = 18, 1 << 16
TILE = 1 << TILE_BITS
#: Bytes of the grams that begin phrases, and how far around them no other one begins: the farther, the fewer phrases to sort and turns to
#: take, and the longer the windows' keys.
HEAD, REACH = 8, 16
#: Windows whose keys are made together.
AT_ONCE = 1 << 17
#: Where the second half of a string of names begins, beyond all positions.
HALF = 1 << 60


def _binary(raw: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as binary values."""
    n, width = raw.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _big(x: np.ndarray) -> np.ndarray:
    """Numbers as 8 bytes that sort like them."""
    return x.astype(">i8").view(np.uint8).reshape(len(x), 8)


def numbered(rows: DataFrame, order: tuple[str, ...], same: str, carry: tuple[str, ...], name: str) -> DataFrame:
    """The ``carry`` columns of ``rows`` with the number of rows before each in ``order`` (row), of those of them with cls 0 (low), and a
    number for each run of rows with equal ``same`` (name).

    ``order`` must tell all rows apart. A task counts its range; ranges pass on their sums and the values at their ends.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row = low = 0
        run_no, first, last = -1, None, None
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(same)
            turn = np.ones(len(key), bool)
            if len(key) > 1:
                turn[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            turn[0] = key[0].as_py() != last
            runs = run_no + np.cumsum(turn)
            zero = batch.column("cls").to_numpy() == 0
            lows = low + np.cumsum(zero) - zero
            n = len(key)
            if first is None:
                first = key[0].as_py()
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(row + np.arange(n)), pa.array(lows), pa.array(runs), pa.nulls(n, key.type), pa.nulls(n, key.type), *[batch.column(c) for c in carry]]
            out = pa.RecordBatch.from_arrays(columns, ["part", "row", "low", "name", "first", "last", *carry])
            schema = out.schema
            yield out
            row, low, run_no, last = row + n, low + int(zero.sum()), int(runs[-1]), key[n - 1].as_py()
        if schema is not None:
            ends = [pa.array([x], kind) for x, kind in zip((part, row, low, run_no + 1, first, last), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), key.type, key.type))]
            yield pa.RecordBatch.from_arrays([*ends, *[pa.nulls(1, schema.field(c).type) for c in carry]], schema=schema)

    spark = rows.sparkSession
    cut = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    edge = rows.schema[same].dataType.simpleString()
    found = parked(cut.mapInArrow(run, f"part int, row long, low long, name long, first {edge}, last {edge}, {kinds}"), name)
    # one row for each range
    sums, total, last = [], [0, 0, 0], None
    for r in found.filter("first IS NOT NULL").select("part", "row", "low", "name", "first", "last").orderBy("part").collect():
        total[2] -= r.first == last
        sums.append((r.part, *total))
        total = [total[0] + r.row, total[1] + r.low, total[2] + r.name]
        last = r.last
    kinds = pa.schema([("part", pa.int32()), ("row0", pa.int64()), ("low0", pa.int64()), ("name0", pa.int64())])
    before = F.broadcast(spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, s)) for s in sums], kinds)))
    out = found.filter("first IS NULL").join(before, "part").select((F.col("row") + F.col("row0")).alias("row"), (F.col("low") + F.col("low0")).alias("low"), (F.col("name") + F.col("name0")).alias("name"), *carry)
    out.held_at = found.held_at
    return out


class Heads:
    """Where phrases begin in each of some texts: grams with the least hash within REACH bytes on both sides, all of which the text must
    have. The texts stand one after another in ``x``, from ``starts`` on; head k is at byte ``at[k]`` of ``x``, in text ``of[k]``."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts, self.ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        # room for what is written behind keys
        self.x = np.frombuffer(b"".join(texts) + bytes(2 * (REACH + HEAD) + 8), np.uint8)
        h = gram_hashes(self.x, HEAD)
        near, n = sliding(h, REACH, np.minimum), len(h) - 2 * REACH
        at = REACH + np.flatnonzero((h[REACH : REACH + n] < near[:n]) & (h[REACH : REACH + n] < near[REACH + 1 : REACH + 1 + n]))
        of = np.searchsorted(self.ends, at, "right")
        inside = of < len(texts)
        at, of = at[inside], of[inside]
        whole = (at - REACH >= self.starts[of]) & (at + REACH + HEAD <= self.ends[of])
        self.at, self.of = at[whole], of[whole]
        #: the number of each text's first head
        self.first = np.searchsorted(self.of, np.arange(len(texts)))


def _slices(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, tails: np.ndarray | None = None) -> pa.Array:
    """The bytes from each start to its end as binary values, each followed by its row of ``tails``, where the end isn't that of the row."""
    sizes = ends - starts
    offsets = np.append(0, np.cumsum(sizes))
    raw = text[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    if tails is not None:
        raw = raw.copy()
        k = np.flatnonzero(tails[1])
        raw[(offsets[1:][k] - 8)[:, None] + np.arange(8)] = _big(tails[0][k])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def phrases(pieces: DataFrame) -> DataFrame:
    """(key, p, cls): the phrases of each piece, with numbers that follow each other from its base on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = Heads(bytes_of(batch))
            if not len(h.at):
                continue
            follows = np.append(h.of[1:] == h.of[:-1], False)
            ends = np.where(follows, np.append(h.at[1:], 0) + REACH + HEAD, h.ends[h.of])
            begin = ((batch.column("tile").to_numpy() << TILE_BITS) + batch.column("base").to_numpy())[h.of]
            yield pa.RecordBatch.from_arrays([_slices(h.x, h.at, ends), pa.array(begin + np.arange(len(h.at)) - h.first[h.of]), pa.array(np.zeros(len(h.at), np.int8))], ["key", "p", "cls"])

    return pieces.mapInArrow(run, "key binary, p long, cls byte")


def _met(values: DataFrame, kind: str, f) -> DataFrame:
    """``f`` on the (p, v, r) of each tile and of the two positions behind it."""
    tile = F.shiftright("p", TILE_BITS)
    here = values.withColumn("tile", tile)
    ahead = values.filter(F.col("p").bitwiseAND(F.lit(TILE - 1)) < 2).withColumn("tile", tile - 1)
    return here.unionByName(ahead).groupBy("tile").applyInArrow(f, kind)


def _dense(table: pa.Table, column: str, tile: int) -> np.ndarray:
    out, value = np.zeros(TILE + 3, np.int64), table.column(column)
    known = pc.is_valid(value).to_numpy(zero_copy_only=False)
    out[table.column("p").to_numpy()[known] - (tile << TILE_BITS)] = value.filter(pc.is_valid(value)).to_numpy()
    return out


def _own(table: pa.Table, tile: int) -> np.ndarray:
    """The tile's own positions, from its begin."""
    p = np.unique(table.column("p").to_numpy()) - (tile << TILE_BITS)
    return p[p < TILE]


def _name_triples(names: DataFrame) -> DataFrame:
    """(key, p, cls): the names of the positions that are 1 or 2 modulo 3 and of the two behind them, of a string of names (p, v)."""

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        v, k = _dense(table, "v", tile), _own(table, tile)
        p = k + (tile << TILE_BITS)
        k, p = k[p % 3 > 0], p[p % 3 > 0]
        return pa.table([_binary(np.concatenate([_big(v[k + j]) for j in range(3)], 1)), pa.array(p), pa.array((p % 3).astype(np.int8))], ["key", "p", "cls"])

    return _met(names, "key binary, p long, cls byte", run)


def _name_sides(string: DataFrame) -> DataFrame:
    """(key, p, cls, side, r): what places the positions that are 0 modulo 3 among the others, of a string of names (p, v, r)."""

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        v, r, k = _dense(table, "v", tile), _dense(table, "r", tile), _own(table, tile)
        cls = (k + (tile << TILE_BITS)) % 3
        none = np.zeros((len(k), 8), np.uint8)
        keys = np.concatenate([np.concatenate([_big(v[k]), _big(r[k + 1]), none], 1), np.concatenate([_big(v[k]), _big(v[k + 1]), _big(r[k + 2])], 1)])
        return _sides(keys, np.tile(k + (tile << TILE_BITS), 2), np.tile(cls, 2), np.tile(r[k], 2), {})

    return _met(string, SIDES, run)


SIDES = "key binary, p long, cls byte, side byte, r long"


def _sides(keys: np.ndarray, p: np.ndarray, cls: np.ndarray, r: np.ndarray, more: dict[str, np.ndarray]) -> pa.Table:
    """Side 0 holds classes 0 and 1, side 1 classes 0 and 2; of each array the first half is for side 0."""
    side = np.repeat(np.arange(2, dtype=np.int8), len(p) // 2)
    keep = np.flatnonzero(cls != 2 - side)
    keys = np.concatenate([side[:, None].view(np.uint8), keys], 1)[keep]
    columns = {"key": _binary(keys), "p": pa.array(p[keep]), "cls": pa.array(cls[keep].astype(np.int8)), "side": pa.array(side[keep]), "r": pa.array(r[keep])}
    return pa.table(columns | {c: pa.array(x[keep], mask=(cls[keep] == 0) & (side[keep] == 1)) for c, x in more.items()})


def _merged(sides: DataFrame) -> DataFrame:
    """(p, r): the rank of every position, from 1 on, equal ones apart or not."""
    placed = numbered(sides, ("key", "p"), "key", ("p", "cls", "side", "r"), "sides")
    zero, side0 = F.col("cls") == 0, F.col("side") == 0
    first = placed.filter(side0).agg(F.count("*"), F.count_if(zero)).first()
    own = F.when(side0, F.col("low")).otherwise(F.col("low") - first[1]) + F.col("r")
    others = placed.filter(~zero).select("p", own.alias("r"))
    half = F.when(side0, F.col("row")).otherwise(F.col("row") - F.col("low") - (first[0] - first[1]))
    zeros = placed.filter(zero).groupBy("p").agg((F.sum(half) + 1).alias("r"))
    return others.unionByName(zeros)


def ranks(names: DataFrame, covered: int, enough: int) -> DataFrame:
    """(p, r): the ranks of the suffixes of a string of names (p, v), which stand for ``covered`` phrases each; ``enough`` phrases decide."""
    named = numbered(_name_triples(names), ("key", "p"), "key", ("p", "cls"), "names")
    sums = named.agg(F.count("*").alias("n"), F.max("name").alias("last")).first()
    if 3 * covered >= enough or not sums.n or sums.last + 1 == sums.n:
        sample = named.select("p", (F.col("row") + 1).alias("r"))
    else:
        up = F.expr(f"p DIV 3 + IF(cls = 2, {HALF}, 0)")
        down = F.expr(f"IF(p >= {HALF}, (p - {HALF}) * 3 + 2, p * 3 + 1)")
        sample = ranks(named.select(up.alias("p"), (F.col("name") + 1).alias("v")), 3 * covered, enough).select(down.alias("p"), "r")
    string = names.withColumn("r", F.lit(None).cast("long")).unionByName(sample.select("p", F.lit(None).cast("long").alias("v"), "r"))
    found = parked(_merged(_name_sides(string)), "ranks")
    discard(named)
    return found


def _placed(pieces: DataFrame, ranked: DataFrame, length: int) -> DataFrame:
    """(key, place, hash) of every window: what sorts it, its byte from the begin of its tile on, and a hash of its bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        tile = left.column("tile")[0].as_py()
        r = _dense(right, "r", tile)
        texts, base = left.column("text").to_pylist(), left.column("base").to_numpy()
        h = Heads(texts)
        n = np.maximum(0, h.ends - h.starts - length + 1)
        of, offsets = np.repeat(np.arange(len(texts)), n), np.cumsum(n) - n
        local = np.arange(n.sum()) - offsets[of]
        s = h.starts[of] + local
        raw, out = h.x.tobytes(), []
        for k in range(0, len(s), AT_ONCE):
            i, o, l = s[k : k + AT_ONCE], of[k : k + AT_ONCE], local[k : k + AT_ONCE]
            first = np.searchsorted(h.at, i + REACH)
            head = np.append(h.at, len(h.x) + length)[first]
            # the head lies in the same text, as the window does
            met = head + REACH + HEAD <= i + length
            ranks_here = r[np.where(met, base[o] + first - h.first[o], TILE)]
            key = _slices(h.x, i, np.where(met, head + REACH + HEAD + 8, i + length), (ranks_here, met))
            hashes = np.array([xxhash.xxh3_64_intdigest(raw[j : j + length]) for j in i.tolist()], np.uint64).view(np.int64)
            out.append(pa.table([key, pa.array((tile << TILE_BITS) + base[o] + l), pa.array(hashes)], schema=schema))
        return pa.concat_tables([schema.empty_table(), *out])

    schema = pa.schema([("key", pa.binary()), ("place", pa.int64()), ("hash", pa.int64())])
    mine = ranked.withColumn("tile", F.shiftright("p", TILE_BITS))
    return pieces.select("tile", "base", "text").groupBy("tile").cogroup(mine.groupBy("tile")).applyInArrow(run, "key binary, place long, hash long")


def later(pieces: DataFrame, length: int) -> DataFrame:
    """(tile, at): the windows of tiles, by their byte from the tile's begin on, whose bytes also start at an earlier place."""
    named = numbered(phrases(pieces), ("key", "p"), "key", ("p",), "phrases")
    # phrases begin more than REACH bytes apart
    ranked = ranks(named.select("p", (F.col("name") + 1).alias("v")), 1, -(-length // (REACH + 1)) + 1)
    discard(named)
    windows = _placed(pieces, ranked, length).withColumn("cls", F.lit(1))
    classes = numbered(windows, ("key", "place"), "hash", ("place",), "classes")
    firsts = classes.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = classes.join(firsts, "name").filter("place > first")
    return found.select(F.shiftright("place", TILE_BITS).alias("tile"), F.col("place").bitwiseAND(F.lit(TILE - 1)).alias("at"))


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, a, b): runs of windows a .. b - 1 of (id, th, text) whose ``length`` bytes also start at an earlier place: in a smaller id,
    for one id in a smaller th, or further ahead in the same text."""
    copies, regions = reduced(rows, length)
    pieces = tiled(regions, length, TILE_BITS, PIECE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        marks = np.zeros(TILE + 1, np.int8)
        marks[right.column("at").to_numpy()] = 1
        base = left.column("base").to_numpy()
        row, begin, end = runs(marks, base)
        from_tile = (left.column("a").to_numpy() - base)[row]
        ids = [left.column(c).take(pa.array(row, pa.int64())) for c in KEYS]
        return pa.table([*ids, pa.array(begin + from_tile), pa.array(end + from_tile)], [*KEYS, "a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    slim = pieces.select("tile", "base", *KEYS, "a")
    sought = slim.groupBy("tile").cogroup(later(pieces, length).groupBy("tile")).applyInArrow(run, f"id {kind}, th long, a long, b long")
    return copies.unionByName(sought)


def deduplicated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier, as in repeats(), judged on the whole input.
    Null texts count as empty; null ids come first. Texts of one id are ordered by a hash; rows that repeat both id and
    text are one document and have the same result. Strings are told apart by their place in the suffix order and 64 bits of
    a hash of their neighbours. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    spans = repeats(rows, length).groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b")).alias("spans")).withColumnRenamed("id", "i").withColumnRenamed("th", "t")
    met = rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for text, spans in zip(bytes_of(batch), batch.column("spans")):
                if not spans.is_valid:
                    cells.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                gone, flat = np.zeros(len(text) + 1, np.int32), spans.values
                np.add.at(gone, flat.field("a").to_numpy(), 1)
                np.add.at(gone, flat.field("b").to_numpy() + length - 1, -1)
                gone = gone.cumsum()[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                cells.append((len(text), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([c[j] for c in cells], k) for j, k in enumerate(kinds)]], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return met.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
