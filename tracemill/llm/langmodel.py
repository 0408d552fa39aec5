"""Bigram language model as a weighted backoff automaton whose weights stay in tables that grow with the corpus.

States are the empty history, the start of a text, and every word that begins a kept bigram. The arcs of a word's state are
the bigrams seen ``least`` times or more in training, whatever the size of the corpus; any other word takes the failure arc to
the empty history, which has an arc for every word. Smoothing is interpolated absolute discounting, with C(b) the
occurrences of b as a history:

    p(w | b) = [n(b, w) >= least] (n(b, w) - DISCOUNT) / C(b) + fail(b) p(w)
    fail(b)  = 1 - sum over the kept arcs of b of (n - DISCOUNT) / C(b)
    p(w)     = (c(w) - off) / N, and off V / N for the one unknown word; off from the words seen once and twice

which sums to 1 over the words and the unknown one. Weights are pushed: the failure weight of a word's state goes to the
arcs that enter it, and a bigram arc weighs its gain, p(w | b) / (fail(b) p(w)). So the log-probability of a path is a sum over
its words of log10 p(w) + log10 fail(w), plus the gains of the bigrams that are arcs, in one traversal from left to right.

Frequent words and arcs (a share of ``share`` of all tokens, so at most 1 / ``share`` of each) are broadcast and added up in
the traversal. It writes the keys of all others with each text; these are joined to the full tables and give the same sums. A
bit map of fixed size tells most bigrams that are no arcs without a join; one that it lets through finds no weight and adds 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import bytes_of, discard, in_fold, parked

#: The end of a text and the state before its first word; words hold no white space.
END, START = b"\n", b" "
DISCOUNT = 0.75
_BITS = 27

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end; bytes.lower() and split() know no other characters."""
    tokens = text.lower().split()
    tokens.append(END)
    return tokens


class Vocabulary(dict):
    """Numbers the words that a task meets, in the order in which it meets them; the start is 0 and the end 1. ``codes`` gives
    each number's 64-bit code, the word's XXH64 made odd."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self._codes: list[int] = []
        self.codes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for word in (START, END):
            self[word]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        code = xxhash.xxh64_intdigest(word, 42) | 1
        self._codes.append(code - (1 << 64) if code >> 63 else code)
        return number

    def read(self, text: bytes) -> np.ndarray:
        tokens = tokens_of(text)
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def learn(self, places) -> None:
        """Brings ``codes`` up to date, and ``places`` by what ``places`` gives for new codes."""
        new = np.array(self._codes[len(self.codes) :], np.int64)
        self.codes, self.places = np.concatenate([self.codes, new]), np.concatenate([self.places, places(new)])


def _long_hash(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = seed + _P5 + np.uint64(8)
    h = h ^ (turn(x * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_keys(history: np.ndarray, word: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """The keys of bigrams: F.xxhash64(history, word), made even, which no code of a word is; ``piece`` at a time."""
    out, h, w = np.empty(len(word), np.uint64), history.view(np.uint64), word.view(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(out), piece):
            out[k : k + piece] = _long_hash(w[k : k + piece], _long_hash(h[k : k + piece], np.uint64(42)))
    out &= ~np.uint64(1)
    return out.view(np.int64)


_START, _END = (int(c) for c in Vocabulary()._codes)
#: A task forgets its words when it has met so many.
FORGET = 400_000


def before(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The states in which the words of texts that begin at ``starts`` are read."""
    states = np.empty_like(words)
    states[1:] = words[:-1]
    states[starts] = 0
    return states


def groups(texts: list[bytes], vocabulary: Vocabulary, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, starts) of as many texts at a time as have about ``most`` words."""
    parts: list[np.ndarray] = []
    total = 0
    for text in texts:
        parts.append(vocabulary.read(text))
        total += len(parts[-1])
        if total >= most:
            yield _joined(parts)
            parts, total = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]


def ngrams(train: DataFrame, least: int = 2, flush: int = 1_000_000) -> DataFrame:
    """(history, word, n): the counts of all words (history 0) and of the bigrams that occur ``least`` times or more, by codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(history: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (history, word, n)], ["history", "word", "n"])

        def words_of() -> pa.RecordBatch:
            met = np.flatnonzero(counts)
            return out(np.zeros(len(met)), vocabulary.codes[met], counts[met])

        vocabulary, counts = Vocabulary(), np.zeros(2, np.int64)
        for batch in batches:
            for words, starts in groups(bytes_of(batch), vocabulary, flush):
                vocabulary.learn(np.zeros_like)
                more = np.bincount(words, minlength=len(vocabulary))
                more[: len(counts)] += counts
                counts = more
                # numbers in place of codes: no two pairs are taken for one
                pairs, n = np.unique((before(words, starts) << 32) | words, return_counts=True)
                yield out(vocabulary.codes[pairs >> 32], vocabulary.codes[pairs & 0xFFFFFFFF], n)
                if len(vocabulary) > FORGET:
                    yield words_of()
                    vocabulary.forget()
                    counts = np.zeros(2, np.int64)
        vocabulary.learn(np.zeros_like)
        yield words_of()

    parts = train.select("text").mapInArrow(run, "history long, word long, n long")
    return parked(parts.groupBy("history", "word").agg(F.sum("n").alias("n")).filter((F.col("history") == 0) | (F.col("n") >= least)), "ngrams")


class SortedKeys:
    """Sorted keys, which are hashes, with the place where each of their leading bits begins."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.view(np.uint64)
        self.bits = max(1, int(len(keys)).bit_length())
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, or -1."""
        w = wanted.view(np.uint64)
        head = (w >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[head].astype(np.int64), self.first[head + 1]
        found, left = np.full(len(w), -1, np.int64), np.flatnonzero(at < end)
        while len(left):
            same = self.keys[at[left]] == w[left]
            found[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found


class Automaton:
    """The broadcast part: the weights of frequent words and arcs, and the bit map of all arcs."""

    def __init__(self, words: tuple[np.ndarray, ...], arcs: tuple[np.ndarray, ...], bits: np.ndarray, start: float):
        order = [np.argsort(x[0].view(np.uint64)) for x in (words, arcs)]
        code, base, weight = (x[order[0]] for x in words)
        arc, gain = (x[order[1]] for x in arcs)
        self.words, self.arcs = SortedKeys(code), SortedKeys(arc)
        # the last is for what isn't found, at -1
        self.base, self.weight, self.gain = np.append(base, 0.0), np.append(weight, 0.0), np.append(gain, 0.0)
        self.bits, self.start = bits, start

    def walk(self, words: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary):
        """For each text: how many words are frequent, their base weights, the weight of the path so far, and how many keys have
        to be joined; and these keys, in the order of the texts."""
        vocabulary.learn(self.words.find)
        place = vocabulary.places[words]
        keys = pair_keys(vocabulary.codes[before(words, starts)], vocabulary.codes[words])
        slot = keys.view(np.uint64) >> np.uint64(64 - _BITS)
        likely = np.flatnonzero((self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
        at = self.arcs.find(keys[likely])
        path = self.weight[place]
        path[likely] += self.gain[at]
        path[starts] += self.start
        asked = np.zeros((len(words), 2), bool)
        asked[:, 0] = place < 0
        asked[likely[at < 0], 1] = True
        wanted = np.stack([vocabulary.codes[words], keys], 1)[asked]
        sums = [np.add.reduceat(x, starts) for x in ((place >= 0).astype(np.int64), self.base[place], path, asked.sum(1))]
        return sums, wanted


def _columns(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


def model_of(train: DataFrame, least: int, share: float):
    """(N, V, log10 probability of an unknown word, the automaton, the table (key, c, weight) of all that isn't in it)."""
    counts = ngrams(train, least)
    words, pairs = counts.filter("history = 0").select(F.col("word").alias("code"), F.col("n").alias("c")), counts.filter("history <> 0")
    n = F.col("c")
    stat = words.agg(F.sum(n).alias("n"), F.count("*").alias("v"), F.count_if(n == 1).alias("once"), F.count_if(n == 2).alias("twice"), F.max(F.when(F.col("code") == _END, n)).alias("ends")).first()
    total, v, ends = max(stat.n or 0, 1), stat.v, stat.ends or 0
    off = stat.once / (stat.once + 2 * stat.twice) if stat.once and stat.twice else 0.5
    mass = parked(pairs.groupBy("history").agg(F.sum(F.col("n") - DISCOUNT).alias("mass")), "states")
    first = mass.filter(F.col("history") == _START).first()
    start = 1 - first.mass / ends if first else 1.0
    # a word that begins no kept bigram has no state of its own: its failure weight is 1
    fail = 1 - F.coalesce("mass", F.lit(0.0)) / n
    known = parked(words.join(mass, F.col("code") == F.col("history"), "left").select("code", "c", ((n - off) / total).alias("p"), fail.alias("fail")), "words")
    tail = known.select(F.col("code").alias("word"), "p")
    head = known.select(F.col("code").alias("history"), "c", "fail").unionByName(known.sparkSession.createDataFrame([(_START, ends, start)], "history long, c long, fail double"))
    key = F.xxhash64("history", "word").bitwiseAND(F.lit(-2))
    gain = F.log10(1 + (F.col("n") - DISCOUNT) / (F.col("c") * F.col("fail") * F.col("p")))
    arcs = parked(pairs.join(tail, "word").join(head, "history").select(key.alias("key"), "n", gain.alias("weight")), "arcs")
    slots = arcs.select(F.shiftrightunsigned("key", 64 - _BITS).alias("slot"))
    marks = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
    at, found = _columns(marks)
    bits = np.zeros(1 << (_BITS - 6), np.uint64)
    bits[at] = found.view(np.uint64)
    hot = max(1.0, share * total)
    weight = F.log10("p") + F.log10("fail")
    often = _columns(known.filter(n >= hot).select("code", F.log10(n + 1.0).alias("base"), weight.alias("weight")))
    automaton = Automaton(often, _columns(arcs.filter(F.col("n") >= hot).select("key", "weight")), bits, math.log10(start))
    rest = known.filter(n < hot).select(F.col("code").alias("key"), "c", weight.alias("weight")).unionByName(arcs.filter(F.col("n") < hot).select("key", F.lit(None).cast("long").alias("c"), "weight"))
    discard(counts, mass)
    return stat.n or 0, v, math.log10(off * v / total) if v else 0.0, automaton, rest


def score(docs: DataFrame, fold: tuple[int, int] = (7, 2), least: int = 2, share: float = 2.5e-7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose id's crc32 modulo ``fold[0]`` is not ``fold[1]`` are learnt from; all are scored. A null text counts as
    empty: its one token is the end. A null id counts as the empty text for the fold. Repeated rows stay apart and count
    as often as they occur. Other columns are ignored. Without training texts every word is unknown, and both scores take
    the base with N = V = 0. Words are told apart by 63 bits of their XXH64. ``share`` changes what is broadcast, not the results.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), in_fold(id_col, *fold).alias("held_out"))
    n, v, unknown, automaton, rest = model_of(rows.filter(~F.col("held_out")), least, share)
    model = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            done = 0
            for words, starts in groups(bytes_of(batch), vocabulary, 500_000):
                (*sums, asked), keys = model.value.walk(words, starts, vocabulary)
                some = batch.slice(done, len(starts))
                done += len(starts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(asked)).astype(np.int32)), pa.array(keys))
                sizes = np.diff(np.append(starts, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [some.column("rid"), some.column("id"), some.column("held_out"), *map(pa.array, (sizes, *sums)), lists], ["rid", "id", "held_out", "n_tokens", "n_hot", "base", "path", "keys"]
                )
                if len(vocabulary) > FORGET:
                    vocabulary.forget()

    schema = f"rid long, id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_hot long, base double, path double, keys array<long>"
    walks = parked(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, schema), "walks", **{"parquet.enable.dictionary": "false"})
    word, c = F.col("key").bitwiseAND(F.lit(1)) == 1, F.coalesce("c", F.lit(0))
    joined = (
        walks.select("rid", F.explode("keys").alias("key"))
        .join(rest, "key", "left")
        .groupBy("rid")
        .agg(
            F.count_if(c > 0).alias("more_known"),
            F.sum(F.log10(c + 1.0)).alias("more_base"),
            F.sum(F.coalesce("weight", F.when(word, unknown).otherwise(0.0))).alias("more_path"),
        )
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return walks.drop("keys").join(joined, "rid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        plus("n_hot", "more_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (plus("base", "more_base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        plus("path", "more_path").alias("score"),
    )
