"""Benchmark passages in documents: q-gram lemma in diagonal bands, then banded alignment.

Texts are compared in lower case with every run of ASCII white space and punctuation as one blank. An item is cut into
windows of ``window`` bytes that begin every ``window`` // 4 bytes (a shorter item is one window); a document holds a window
if some part of it is within ``rate`` edits a byte. Such a part shares at least length - q + 1 - edits * q q-grams with the
window, all within a band of diagonals as wide as the edits, which leaves few places to align.

A verbatim quote of ``window`` + ``window`` // 4 - 1 bytes (124 of production's 100 and 25) holds a whole window wherever it
begins, so it is always found; shorter parts of longer items are found only if they happen to hold one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import discard, parked, texts_of

_BLANKS = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))
_MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), 21
_ODD = np.uint64(0xD6E8FEB86659FD93)


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split())


def places(text: str) -> np.ndarray:
    """For each byte of normal(text), the character of ``text`` it comes from."""
    raw, at = [], []
    low = text.lower()
    whole = len(low) == len(text)
    for i, c in enumerate(low if whole else text):
        b = (c if whole else c.lower()).encode("utf-8", "surrogatepass").translate(_BLANKS)
        raw.append(b)
        at += [i] * len(b)
    b = np.frombuffer(b"".join(raw), np.uint8)
    blank = b == 32
    keep = ~blank
    # of blanks between words the last one stays
    words = np.flatnonzero(keep)
    if len(words):
        starts = words[1:][blank[words[1:] - 1]]
        keep[starts - 1] = True
    return np.array(at, np.int64)[keep]


class Index:
    """The windows of some items: equal ones are one, with all their items, and a few q-grams of each propose places.

    A part within ``edits`` of a window holds one of any edits + 1 grams of it that don't overlap, unchanged and within as many
    diagonals; those are taken that are rarest in the index. So a proposal costs no count of all grams, and what a text and
    the items repeat is multiplied for few of them only, in steps of bounded size.
    """

    def __init__(self, texts: list[bytes], q: int = 10, window: int = 100, rate: float = 0.08):
        self.q, self.window, self.rate = q, window, rate
        place: dict[bytes, int] = {}
        of, item = [], []
        for i, t in enumerate(texts):
            if len(t) < q:
                continue
            last = max(0, len(t) - window)
            for a in sorted({*range(0, last, max(1, window // 4)), last}):
                of.append(place.setdefault(t[a : a + window], len(place)))
                item.append(i)
        wins = list(place)
        # the items of each window, and how often they hold it
        pairs, self.times = np.unique(np.array([of, item], np.int64).reshape(2, -1), axis=1, return_counts=True)
        self.item, self.first_item = pairs[1].astype(np.int32), np.searchsorted(pairs[0], np.arange(len(wins) + 1))
        lengths = self.length = np.array([len(w) for w in wins], np.int64)
        # no more edits than leave one shared q-gram
        self.edits = np.minimum((lengths * rate).astype(np.int64), np.maximum(0, (lengths - q) // q))
        self.band = int(max(1, self.edits.max(initial=0)))
        self.bytes = np.zeros((len(wins), window), np.uint8)
        for k, w in enumerate(wins):
            self.bytes[k, : len(w)] = np.frombuffer(w, np.uint8)
        # the code of every gram that lies in one window, by window and place
        flat = np.append(self.codes(self.bytes.ravel()), np.zeros(q - 1, np.uint64)) if len(wins) else np.zeros(0, np.uint64)
        grams = flat.reshape(len(wins), window)
        every, count = np.unique(grams[np.arange(window) <= lengths[:, None] - q], return_counts=True)
        code, win, off = [], [], []
        for length in np.unique(lengths).tolist():
            for k in np.array_split(np.flatnonzero(lengths == length), -(-len(wins) // 8192)):
                if not len(k):
                    continue
                n = int(self.edits[k[0]]) + 1
                at = np.arange(length - n * q + 1)[:, None] + np.arange(n) * q
                often = count[np.searchsorted(every, grams[k][:, : length - q + 1])]
                best = at[often[:, at].sum(2).argmin(1)]
                code.append(np.take_along_axis(grams[k], best, 1).ravel())
                win.append(np.repeat(k, n).astype(np.int32))
                off.append(best.ravel().astype(np.int32))
        code = np.concatenate(code) if code else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.win = np.concatenate(win)[order] if win else np.zeros(0, np.int32)
        self.off = np.concatenate(off)[order] if off else np.zeros(0, np.int32)
        self.code, first = np.unique(code[order], return_index=True)
        self.first, self.many = first.astype(np.int32), np.diff(np.append(first, len(code))).astype(np.int32)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.slots(self.code)] = True

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _MIX) >> np.uint64(64 - _BITS)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A 64-bit code of the q-gram at each position: its first and its last eight bytes, mixed."""
        n, q = len(x) - self.q + 1, self.q
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = x.tobytes() + bytes(8)
        eight = np.empty(len(x), np.uint64)
        for k in range(8):
            part = np.frombuffer(raw, "<u8", (len(x) - k + 7) // 8, k)
            eight[k::8] = part
        if q <= 8:
            return eight[:n] & np.uint64((1 << (8 * q)) - 1)
        return eight[:n] ^ (eight[q - 8 : q - 8 + n] * _MIX)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Aligned windows in ``x``: (window, edits, start, end), for a buffer of normalized texts parted by runs of 0."""
        none = (np.zeros(0, np.int64),) * 4
        codes = self.codes(x)
        if not len(codes) or not len(self.code):
            return none
        p = np.flatnonzero(self.seen[self.slots(codes)])
        at = np.minimum(np.searchsorted(self.code, codes[p]), len(self.code) - 1)
        real = self.code[at] == codes[p]
        p, at = p[real], at[real]
        if not len(p):
            return none
        keys = self.proposed(p, at, (len(x) + 2 * self.window) // self.band + 3)
        w, lane = np.divmod(keys, (len(x) + 2 * self.window) // self.band + 3)
        return self.aligned(x, w, (lane - 1) * self.band - self.window)

    def proposed(self, p: np.ndarray, at: np.ndarray, lanes: int, at_once: int = 1 << 20) -> np.ndarray:
        """The distinct (window, lane of diagonals) of hits at ``p``, as one number; a lane and the next one make a band, so each drift fits
        in one. Hits are multiplied by their windows ``at_once`` at a time, which bounds memory by the distinct results."""
        total = np.cumsum(self.many[at], dtype=np.int64)
        found: list[np.ndarray] = []
        waiting, start = 0, 0
        while start < len(p):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + at_once, "right")))
            n = self.many[at[start:end]].astype(np.int64)
            entry = np.repeat(self.first[at[start:end]] - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())
            lane = (np.repeat(p[start:end], n) - self.off[entry] + self.window) // self.band + 1
            key = self.win[entry].astype(np.int64) * lanes + lane
            found.append(np.unique(np.concatenate([key, key - 1])))
            waiting += len(found[-1])
            if waiting > 4 * at_once:
                found = [np.unique(np.concatenate(found))]
                waiting = len(found[0]) // 2
            start = end
        return np.unique(np.concatenate(found))

    def aligned(self, x: np.ndarray, w: np.ndarray, diagonal: np.ndarray, at_once: int = 1 << 18):
        """align() of each window and band, once for all places where a window meets the same bytes."""
        edits, out = int(self.edits.max(initial=0)), []
        width = self.window + 2 * self.band + 2 * edits + 1
        side = self.window + width
        padded = np.concatenate([np.zeros(2 * side, np.uint8), x, np.zeros(2 * side, np.uint8)])
        power = np.ones(len(padded) + 1, np.uint64)
        power[1:] = _ODD
        power = np.multiply.accumulate(power)
        sums = np.zeros(len(padded) + 1, np.uint64)
        np.cumsum((padded + np.uint64(1)) * power[:-1], out=sums[1:])
        for k in range(0, len(w), at_once):
            ws, ds = w[k : k + at_once], diagonal[k : k + at_once]
            a = ds - edits + 2 * side
            # what stands in the band, as a number that doesn't depend on its place
            seen = (sums[a + width] - sums[a]) * power[len(padded) - a]
            order = np.lexsort((seen, ws))
            new = np.append(True, (np.diff(ws[order]) != 0) | (np.diff(seen[order]) != 0)) if len(order) else np.zeros(0, bool)
            one, group = order[new], np.cumsum(new) - 1
            may = self.near(padded, ws[one], a[one])
            got = np.full((4, len(one)), -1, np.int64)
            kept = np.flatnonzero(may)
            for j in range(0, len(kept), 4096):
                some = kept[j : j + 4096]
                which, e, begin, end = self.align(padded, ws[one[some]], a[one[some]])
                got[:, some[which]] = np.stack([ws[one[some[which]]], e, begin - ds[one[some[which]]], end - ds[one[some[which]]]])
            mine = got[:, group]
            ok = mine[0] >= 0
            there = ds[order[ok]]
            out.append((mine[0, ok], mine[1, ok], mine[2, ok] + there - 2 * side, mine[3, ok] + there - 2 * side))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4

    def near(self, padded: np.ndarray, w: np.ndarray, base: np.ndarray, block: int = 5, at_once: int = 2048) -> np.ndarray:
        """Whether a window may be within its edits of the band: of its blocks of 5 bytes each edit spoils one, the others stand in the band."""
        shifts = 2 * self.band + 2 * int(self.edits.max(initial=0)) + 1
        ok = np.zeros(len(w), bool)
        four = lambda y: y[..., :-4].astype(np.uint64) | (y[..., 1:-3].astype(np.uint64) << np.uint64(8)) | (y[..., 2:-2].astype(np.uint64) << np.uint64(16)) | (y[..., 3:-1].astype(np.uint64) << np.uint64(24)) | (y[..., 4:].astype(np.uint64) << np.uint64(32))
        starts = np.arange(0, self.window - block + 1, block)
        for k in range(0, len(w), at_once):
            ws = w[k : k + at_once]
            text = four(padded[base[k : k + at_once][:, None] + np.arange(self.window + shifts)])
            mine = four(self.bytes[ws])[:, starts]
            same = np.zeros(mine.shape, bool)
            for s in range(shifts):
                same |= text[:, starts + s] == mine
            whole = starts + block <= self.length[ws][:, None]
            ok[k : k + at_once] = (same & whole).sum(1) >= whole.sum(1) - self.edits[ws]
        return ok

    def align(self, padded: np.ndarray, w: np.ndarray, base: np.ndarray):
        """Banded alignment of windows ``w`` with any part of the bytes from ``base`` on: (which of them are within their edits, edits, start,
        end)."""
        width = 2 * self.band + 2 * int(self.edits.max(initial=0)) + 1
        cols = np.arange(width)
        # value: edits in the upper bits, the column where the part starts in the lower ones
        v = np.broadcast_to(cols, (len(w), width)).astype(np.int32)
        done = v.copy()
        length = self.length[w]
        for i in range(self.window):
            text = padded[base[:, None] + i + cols]
            cost = v + ((text != self.bytes[w, i][:, None]) << 12)
            cost[:, :-1] = np.minimum(cost[:, :-1], v[:, 1:] + (1 << 12))
            cost -= cols.astype(np.int32) << 12
            v = np.minimum.accumulate(cost, axis=1) + (cols.astype(np.int32) << 12)
            over = length == i + 1
            done[over] = v[over]
        best = done.argmin(1)
        value = done[np.arange(len(w)), best]
        edits, begin = value >> 12, value & 4095
        good = np.flatnonzero(edits <= self.edits[w])
        return good, edits[good].astype(np.int64), (base + begin)[good], (base + length + best)[good]

    def search(self, texts: list[str], size: int = 1 << 21) -> list[dict[int, tuple[int, int, int, int]]]:
        """For each text, {item: (windows held, fewest edits of one, first byte, byte after the last)} in its normal form.

        The texts stand in one buffer with more zeros between them than a window has bytes. An alignment may begin or end in
        those zeros, where each byte is an edit, so its middle tells whose it is, and its ends are cut to that text.
        """
        found: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        gap = bytes(self.window + self.q)
        k = 0
        while k < len(texts):
            parts, starts, sizes, total, first = [], [], [], 0, k
            while k < len(texts) and (total < size or k == first):
                t = normal(texts[k])
                starts.append(total)
                sizes.append(len(t))
                parts += [t, gap]
                total += len(t) + len(gap)
                k += 1
            w, edits, a, b = self.find_long(np.frombuffer(b"".join(parts), np.uint8))
            if not len(w):
                continue
            starts, sizes = np.array(starts), np.array(sizes)
            i = np.searchsorted(starts, (a + b) // 2, "right") - 1
            a, b = np.maximum(0, a - starts[i]), np.minimum(sizes[i], b - starts[i])
            order = np.lexsort((w, i))
            w, edits, i, a, b = (v[order] for v in (w, edits, i, a, b))
            cut = np.flatnonzero(np.append(True, (np.diff(w) != 0) | (np.diff(i) != 0)))
            groups = zip(*(v.tolist() for v in (w[cut], i[cut], np.minimum.reduceat(edits, cut), np.minimum.reduceat(a, cut), np.maximum.reduceat(b, cut))))
            for window, row, e, x, y in groups:
                held = found[first + row]
                for j in range(self.first_item[window], self.first_item[window + 1]):
                    item, n = int(self.item[j]), int(self.times[j])
                    old = held.get(item)
                    held[item] = (n, e, x, y) if old is None else (old[0] + n, min(old[1], e), min(old[2], x), max(old[3], y))
        return found

    def find_long(self, x: np.ndarray, size: int = 1 << 22):
        """find() over pieces of at most ``size`` bytes that overlap by more than a window, so that memory has a bound."""
        lap = 2 * (self.window + self.band)
        if len(x) <= size:
            return self.find(x)
        got = []
        for k in range(0, max(1, len(x) - lap), size - lap):
            w, e, a, b = self.find(x[k : k + size])
            got.append((w, e, a + k, b + k))
        return tuple(np.concatenate(c) for c in zip(*got))


def indexes(benchmark: DataFrame, q: int = 10, window: int = 100, rate: float = 0.08, id_col: str = "item_id", text_col: str = "text", most: int = 4 << 20):
    """The ids of the items, an index of them for every ``most`` bytes or so of their texts, and whether it is the last; each is broadcast,
    used and let go before the next one is made."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    part: list = []
    total = 0
    for r in items.orderBy("id", "text").toLocalIterator():
        if total >= most:
            yield [i for i, _ in part], Index([t for _, t in part], q, window, rate), False
            part, total = [], 0
        t = normal(r.text)
        part.append((r.id, t))
        total += len(t)
    yield [i for i, _ in part], Index([t for _, t in part], q, window, rate), True


def matches(docs: DataFrame, benchmark: DataFrame, q: int = 10, window: int = 100, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs`` and benchmark item of which it holds a window: the ids, n_windows held, edits (fewest of a
    window), start and end (characters of the document that span the windows held).

    Null texts hold nothing; null items and items of fewer than ``q`` bytes are held by nothing. An item listed twice with
    one text counts once. Repeated documents give repeated rows. Other columns are ignored. A benchmark larger than an index
    takes several passes over the documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, n_windows long, edits long, start long, end long"
    result = None
    for ids, index, last in indexes(benchmark, q, window, rate, item_col, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast((ids, index))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, index = shipped.value
            for batch in batches:
                texts = texts_of(batch)
                row, item, cells = [], [], []
                for i, held in enumerate(index.search(texts)):
                    if held:
                        at = places(texts[i])
                        for k, (n, edits, a, b) in sorted(held.items()):
                            row.append(i)
                            item.append(names[k])
                            cells.append((n, edits, int(at[a]), int(at[b - 1]) + 1))
                if row:
                    columns = [pa.array([c[j] for c in cells], pa.int64()) for j in range(4)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), pa.array(item), *columns], [id_col, item_col, "n_windows", "edits", "start", "end"])

        part = rows.mapInArrow(run, schema)
        if result is not None or not last:
            part = parked(part, "matches")
            shipped.unpersist()
        result = part if result is None else result.unionByName(part)
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, window: int = 100, rate: float = 0.08, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of a benchmark item."""
    at = docs.columns.index(text_col)
    before = None
    for _, index, last in indexes(benchmark, q, window, rate, item_col, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not held for held in shipped.value.search([t or "" for t in batch.column(at).to_pylist()])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = parked(docs, "clean")
            shipped.unpersist()
            if before is not None:
                discard(before)
            before = docs
    return docs
