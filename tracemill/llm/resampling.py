"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel noise, and exact ranks by a histogram."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm._shared import bytes_of, id_text, parked

BUCKETS, ORDER = 10_000, 3
#: Digits, letters in lower case, and all bytes of characters beyond ASCII.
_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: A task forgets its words when it has met so many; words up to so many bytes are joined by table.
FORGET, LONGEST = 400_000, 63


def _shifts() -> np.ndarray:
    """[bytes, which byte of a checksum, its value]: what a CRC-32 becomes when so many zero bytes follow, which is linear in its bits."""
    table = np.zeros(256, np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[i] = c
    out = np.zeros((LONGEST + 2, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for k in range(LONGEST + 2):
        out[k] = values
        values = table[values & 255] ^ (values >> 8)
    return out


class Features:
    """Numbers the words that a task meets; gives the buckets of all runs of 1 to 3 words of texts."""

    def __init__(self):
        self.shift = _shifts()
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.alone, self.behind, self.sizes = (np.zeros(0, np.uint32) for _ in range(3))

    def read(self, text: bytes) -> np.ndarray:
        number, out = self.number, []
        for w in _words(text.lower()):
            k = number.get(w)
            if k is None:
                k = number[w] = len(self.words)
                self.words.append(w)
            out.append(k)
        return np.array(out, np.int64)

    def learn(self) -> None:
        """Brings the checksums up to date: of a word, and of a blank and the word; and the bytes of the latter."""
        new = self.words[len(self.alone) :]
        cells = [[f(w) for w in new] for f in (crc32, lambda w: crc32(b" " + w), lambda w: len(w) + 1)]
        self.alone, self.behind, self.sizes = (np.concatenate([a, np.array(c, np.uint32)]) for a, c in zip((self.alone, self.behind, self.sizes), cells))

    def joined(self, front: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The checksums of texts with checksum ``front`` followed by a blank and a word."""
        size = self.sizes[word]
        s, k = self.shift, np.minimum(size, LONGEST + 1)
        out = s[k, 0, front & 255] ^ s[k, 1, (front >> 8) & 255] ^ s[k, 2, (front >> 16) & 255] ^ s[k, 3, front >> 24] ^ self.behind[word]
        for i in np.flatnonzero(size > LONGEST + 1).tolist():
            out[i] = crc32(b" " + self.words[word[i]], int(front[i]))
        return out

    def buckets(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length of runs, the buckets of all of them and the place of their last words; texts begin at ``starts``."""
        self.learn()
        ends, at = self.alone[words], np.arange(len(words))
        out = [(ends % BUCKETS, at)]
        place = at - np.repeat(starts, np.diff(np.append(starts, len(words))))
        for n in range(1, ORDER):
            at = np.flatnonzero(place >= n)  # a run ends at each word that has n before it in its text
            longer = np.zeros_like(ends)
            longer[at] = self.joined(ends[at - 1], words[at])
            ends = longer
            out.append((ends[at] % BUCKETS, at))
        return out


def _groups(texts: list[bytes], features: Features, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, starts) of as many texts at a time as have about ``most`` words."""
    parts, total = [], 0
    for k, text in enumerate(texts):
        parts.append(features.read(text))
        total += len(parts[-1])
        if total >= most or k == len(texts) - 1:
            yield np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]
            parts, total = [], 0


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features fall into each bucket; a task adds them up and passes on one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, n = Features(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, starts in _groups(bytes_of(batch), features):
                for bucket, _ in features.buckets(words, starts):
                    n += np.bincount(bucket, minlength=BUCKETS)
                if len(features.words) > FORGET:
                    features.forget()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(n)], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, rounded down."""
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc: str, seed: int) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, benchmark: DataFrame, seed: int, id_col: str, text_col: str, target_text: str) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each document, written once."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text_col), bucket_counts(benchmark, target_text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            done = 0
            for words, starts in _groups(bytes_of(batch), features):
                sizes = np.diff(np.append(starts, len(words)))
                weight = np.zeros(len(words), np.int64)
                for bucket, at in features.buckets(words, starts):
                    weight[at] += gain.value[bucket]
                sums = np.append(0, weight.cumsum())
                weights = sums[starts + sizes] - sums[starts]
                some = batch.slice(done, len(starts))
                done += len(starts)
                scores = weights + np.array([noise(i, seed) for i in some.column("key").to_pylist()], np.int64)
                n = sum(np.maximum(sizes - k, 0) for k in range(ORDER))
                yield pa.RecordBatch.from_arrays([some.column("id"), *map(pa.array, (sizes, n, weights, scores))], ["id", "n_words", "n_features", "weight", "score"])
                if len(features.words) > FORGET:
                    features.forget()

    rows = docs.select(F.col(id_col).alias("id"), id_text(id_col).alias("key"), F.col(text_col).alias("text"))
    return parked(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long"), "scores")


#: A window of the histogram holds 2 ** DIGIT scores at most; scores have less than LEVELS * DIGIT bits.
DIGIT, LEVELS = 16, 3


def score_offsets(rows: DataFrame) -> DataFrame:
    """(score, n, above): how many rows have each score, and how many a higher one.

    Counts of scores are summed by their leading bits, level by level; each level's counts are summed from above within the
    same leading bits, so that a window holds 2 ** DIGIT rows at most, and the sums of the levels add up.
    """
    table = rows.groupBy("score").agg(F.count("*").alias("n")).withColumn("k0", F.col("score"))
    for level in range(1, LEVELS):
        table = table.withColumn(f"k{level}", F.shiftright("score", level * DIGIT))
    table = parked(table, "histogram")
    above = F.lit(0).cast("long")
    out = table
    for level in range(LEVELS):
        key, parent = f"k{level}", F.col(f"k{level + 1}") if level + 1 < LEVELS else F.lit(0)
        sums = table.groupBy(key).agg(F.sum("n").alias("m"), F.first(parent).alias("parent"))
        higher = F.sum("m").over(Window.partitionBy("parent").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1))
        out = out.join(sums.select(key, F.coalesce(higher, F.lit(0)).alias(f"above{level}")), key)
        above = above + F.col(f"above{level}")
    return out.select("score", "n", above.alias("above"))


def resampled(docs: DataFrame, benchmark: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, and the rank (1, 2, ...) of those drawn, else null.

    Drawn are the ``percent`` hundredths, rounded down, of the rows with ``least_words`` words or more that have the highest
    scores, ties to the smaller id (nulls first). Null and empty texts have no features and weight 0. A null id counts as the
    empty text for the noise. Repeated rows are rows of their own; which of two rows with one id and score has the
    smaller rank is arbitrary. Empty tables give empty ones; an empty benchmark is a target of no features. Other columns are ignored.
    """
    rows = scored(docs, benchmark, seed, id_col, text_col, target_text)
    able = rows.filter(F.col("n_words") >= least_words)
    offsets = parked(score_offsets(able), "offsets")
    n = offsets.agg(F.sum("n")).first()[0] or 0
    drawn = n * percent // 100
    cutoff = offsets.filter(F.col("above") < drawn).agg(F.min("score")).first()[0]
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff) if cutoff is not None else F.lit(False)
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("id"))
    top = rows.filter(high).join(offsets.select("score", "above"), "score").withColumn("rank", F.when(place <= drawn, place))
    rest = rows.filter(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return top.select("id", "n_features", "weight", "score", "rank").unionByName(rest.select("id", "n_features", "weight", "score", "rank")).withColumnRenamed("id", id_col)
