"""Toxicity of documents by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm import _labelled
from tracemill.llm._shared import texts_of

_word = re.compile(r"[^\W\d_]+").findall
PREFIXES = (4, 5)


def words_of(text: str) -> set[str]:
    return set(_word(text.lower()))


def hashes_of(word: str) -> list[int]:
    """The hashes of a word's terms: itself, and its first 4 and 5 letters, which stems share under any ending."""
    return [crc32(word.encode("utf-8", "surrogatepass")), *[crc32(f"{n}:{word[:n]}".encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n]]


def terms_of(text: str) -> np.ndarray:
    """The sorted distinct hashes of a whole text's terms."""
    return np.array(sorted({h for w in words_of(text) for h in hashes_of(w)}), np.uint32)


def _places(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where those of ``x`` that are among the values stand."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at[sorted_values[at] == x]


def _pairs(terms: np.ndarray, bits: int, at_once: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a document's terms as one number, and their slots, some rows at a time."""
    step = max(1, at_once // max(1, len(terms)))
    for k in range(0, len(terms), step):
        i, j = np.nonzero(np.arange(k, min(len(terms), k + step))[:, None] < np.arange(len(terms))[None, :])
        pair = (terms[i + k].astype(np.int64) << 32) | terms[j]
        mixed = (pair.view(np.uint64) ^ (pair.view(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield pair, ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def _chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


class FactorizationMachine:
    """Log odds = bias + sum of the weights of the terms present + sum over their pairs of the inner products of their factors.

    Of all hashed terms those are kept whose frequency differs between the classes beyond chance, and those of pairs that
    occur together beyond what the terms kept so far explain, however little each tells alone. ``slot`` numbers them.
    """

    def __init__(self, terms: int = 16_384, factors: int = 8, seed: int = 0):
        self.terms, self.factors, self.seed = terms, factors, seed
        self.slot: dict[int, int] = {}
        self.bias, self.w, self.v = 0.0, np.zeros(0), np.zeros((0, factors))

    def fit(self, docs: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
        """Learn from the hashed terms of documents: by single terms first, then with those of telling pairs if there are any."""
        share = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        if not len(y):
            return self
        # terms of fewer documents than this tell nothing in what follows
        hashes, df = np.unique(np.concatenate(docs), return_counts=True)
        hashes = hashes[df >= 3]
        ids = [_places(hashes, d) for d in docs]
        single = self._single(ids, len(hashes), y)
        self._learn(hashes, single, ids, y)
        more = np.setdiff1d(self._paired(ids, len(hashes), y - _chance(self._logits(docs))), single)
        if len(more):
            self._learn(hashes, np.concatenate([single, more])[: self.terms], ids, y)
        return self

    def _single(self, ids: list[np.ndarray], n: int, y: np.ndarray, z: float = 4.0, least: int = 3) -> np.ndarray:
        df = np.stack([np.bincount(np.concatenate([d for d, t in zip(ids, y) if t == c] or [np.zeros(0, np.int64)]), minlength=n) for c in (0, 1)])
        of = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
        p, both = df / of[:, None], (df.sum(0) + 1) / (of.sum() + 2)
        score = np.abs(p[1] - p[0]) / np.sqrt(both * (1 - both) * (1 / of[0] + 1 / of[1]))
        keep = np.flatnonzero((score >= z) & (df.sum(0) >= least))
        return keep[np.argsort(-score[keep], kind="stable")][: self.terms]

    def _paired(self, ids: list[np.ndarray], n: int, rest: np.ndarray, z: float = 6.0, least: int = 8, evidence: float = 0.1, bits: int = 24) -> np.ndarray:
        """The terms of pairs whose documents' residuals ``rest`` sum to ``z`` standard deviations or more, strongest first, of all pairs of
        terms with ``least`` documents.

        Pairs of documents whose residual is ``evidence`` or more are hashed to 2 ** ``bits`` sums; those of telling sums are then worked out
        over all documents. Terms that occur in the same documents are one.
        """
        df = np.bincount(np.concatenate(ids), minlength=n)
        keys, sums = np.random.default_rng(self.seed).integers(0, 1 << 63, len(ids), dtype=np.uint64), np.zeros(n, np.uint64)
        for key, d in zip(keys, ids):
            sums[d] += key
        able = np.flatnonzero(df >= least)
        _, first, group = np.unique(sums[able], return_index=True, return_inverse=True)
        of = np.full(n, -1)
        of[able] = group
        docs = [np.unique(g[g >= 0]) for g in (of[d] for d in ids)]
        telling = [i for i in np.argsort(-np.abs(rest), kind="stable").tolist() if abs(rest[i]) >= evidence]
        total, spread = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
        for i in telling:
            for _, slot in _pairs(docs[i], bits):
                np.add.at(total, slot, np.float32(rest[i]))
                np.add.at(spread, slot, np.float32(rest[i] ** 2))
        good = np.abs(total) >= 0.6 * z * np.sqrt(spread + 1e-9)
        good &= spread >= 0.5 * least * float((rest**2).mean())
        del total, spread
        found = [pair[good[slot]] for i in telling for pair, slot in _pairs(docs[i], bits)]
        pairs, often = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        pairs = pairs[often >= least // 2]
        where = np.argsort(np.concatenate(docs), kind="stable") if len(docs) else np.zeros(0, np.int64)
        doc_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[where]
        begin = np.searchsorted(np.sort(np.concatenate(docs)), np.arange(len(first) + 1))
        best, floor = np.zeros(len(first)), least * float((rest**2).mean())
        for a, b in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
            both = rest[np.intersect1d(doc_of[begin[a] : begin[a + 1]], doc_of[begin[b] : begin[b + 1]], assume_unique=True)]
            square = float((both**2).sum())
            strength = abs(float(both.sum())) / np.sqrt(square + 1e-9) if square >= floor else 0.0
            best[a], best[b] = max(best[a], strength), max(best[b], strength)
        terms = able[best[group] >= z]
        return terms[np.argsort(-best[of[terms]], kind="stable")]

    def _learn(self, hashes: np.ndarray, kept: np.ndarray, ids: list[np.ndarray], y: np.ndarray, epochs: int = 20, batch: int = 64, steps: int = 1500, rate: float = 0.02, decay: float = 1e-3) -> None:
        """Adam on the log loss, for ``epochs`` epochs and ``steps`` steps at least."""
        n, k = len(kept), self.factors
        number = np.full(len(hashes), -1)
        number[kept] = np.arange(n)
        rows = [r[r >= 0] for r in (number[d] for d in ids)]
        rng = np.random.default_rng(self.seed)
        epochs = max(epochs, -(-steps * batch // len(y)))
        p = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.05, (n, k))], 1)  # a weight and the factors of each term
        bias = np.array([self.bias])
        m, s = [np.zeros_like(p), np.zeros(1)], [np.zeros_like(p), np.zeros(1)]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for start in range(0, len(y), batch):
                some = order[start : start + batch]
                at = np.concatenate([rows[i] for i in some])
                of = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
                x, sums = p[at], np.zeros((len(some), k + 1))
                np.add.at(sums, of, x)
                own = np.bincount(of, (x[:, 1:] ** 2).sum(1), len(some))
                d = (_chance(bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - own)) - y[some]) / len(some)
                g = sums[of] - x
                g[:, 0] = 1
                g *= d[of, None]
                gp = np.stack([np.bincount(at, g[:, c], n) for c in range(k + 1)], 1) + decay * p / len(y)
                step += 1
                lr = rate * (1 - epoch / epochs)
                for w, grad, a, b in zip((p, bias), (gp, d.sum(keepdims=True)), m, s):
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad**2 - b)
                    w -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.bias, self.w, self.v = float(bias[0]), p[:, 0].copy(), p[:, 1:].copy()
        self.slot = {int(h): i for i, h in enumerate(hashes[kept])}

    def _logit(self, at: np.ndarray) -> float:
        v = self.v[at]
        return self.bias + float(self.w[at].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())

    def _logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.array([self._logit(np.array(sorted(self.slot[h] for h in d.tolist() if h in self.slot), np.int64)) for d in docs], np.float64)

    def scorer(self, remembered: int = 400_000):
        """The function from texts to scores; it remembers the slots of so many words at most."""
        memo: dict[str, tuple[int, ...]] = {}
        slot = self.slot

        def one(text: str) -> float:
            ids: set[int] = set()
            for word in words_of(text):
                got = memo.get(word)
                if got is None:
                    if len(memo) >= remembered:
                        memo.clear()
                    got = memo[word] = tuple(slot[h] for h in hashes_of(word) if h in slot)
                if got:
                    ids.update(got)
            return self._logit(np.array(sorted(ids), np.int64)) if ids else self.bias

        return lambda texts: _chance(np.array([one(t) for t in texts], np.float64))


def learnt(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str, text_col: str, label_col: str) -> FactorizationMachine:
    """The machine of a sample of labelled documents, whose hashed terms are worked out in tasks and come as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([terms_of(t).view(np.int32) for t in texts_of(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), terms], ["key", "y", "terms"])

    rows = _labelled.sample(docs, labels, label_col, train_rows, id_col=id_col, text_col=text_col).mapInArrow(run, "key string, y double, terms array<int>").toArrow()
    order = np.argsort(np.array(rows.column("key").to_pylist(), dtype=object), kind="stable")
    terms = [x.values.to_numpy().view(np.uint32) for x in rows.column("terms")]
    return FactorizationMachine().fit([terms[i] for i in order], rows.column("y").to_numpy()[order])


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 8192, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher: more toxic), predicted (1 if score >= ``threshold``).

    The machine learns on the driver from the hashed terms of at most ``train_rows`` labelled documents, whole texts, whose
    id's crc32 modulo 5 is not 0; every whole text is scored. A text without a kept term, null and empty ones included, has
    the score of the bias. Without labels that is one half for every text. Repeated rows and other columns don't matter.
    """
    machine = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, train_rows, id_col, text_col, label_col))
    return _labelled.scored(docs, lambda: machine.value.scorer(), threshold, id_col=id_col, text_col=text_col)
