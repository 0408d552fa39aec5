"""Quality of documents by a convolutional network over their bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm import _labelled

PAD = 256


class ByteConvNet:
    """``filters`` filters over ``width`` bytes; the maximum of each in every chunk of ``chunk`` windows; from the chunks' mean
    and maximum one probability.

    A window starts at every byte of a document, so neighbouring chunks overlap by ``width`` - 1 bytes and together they
    cover all of it. Filters are kept as tables (offset, byte, filter).
    """

    def __init__(self, filters: int = 12, width: int = 5, chunk: int = 512, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.chunk, self.width = chunk, width
        self.p = {
            "table": rng.normal(0, 0.25, (width, PAD + 1, filters)).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "out": np.concatenate([rng.normal(0, 0.5, filters), np.zeros(filters)]).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def _bytes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass") or b"\0", np.uint8)
        x = np.full(len(raw) + self.width - 1, PAD, np.int16)
        x[: len(raw)] = raw
        if not text:
            x[0] = PAD
        return x

    def _windows(self, x: np.ndarray) -> np.ndarray:
        t, n = self.p["table"], len(x) - self.width + 1
        z = t[0].take(x[:n], 0)
        for o in range(1, self.width):
            z += t[o].take(x[o : o + n], 0)
        return z

    def _pooled(self, x: np.ndarray, where: bool = False):
        """The maxima by chunk, and if asked for the windows that reach them."""
        n, c = len(x) - self.width + 1, self.chunk
        most, at = [], []
        for k in range(0, n, 64 * c):  # 64 chunks at a time, whatever the length
            z = self._windows(x[k : k + 64 * c + self.width - 1])
            if where:
                for j in range(0, len(z), c):
                    a = z[j : j + c].argmax(0)
                    at.append(a + k + j)
                    most.append(z[j : j + c][a, np.arange(z.shape[1])][None])
            else:
                most.append(np.maximum.reduceat(z, np.arange(0, len(z), c), axis=0))
        most = np.concatenate(most)
        return (most, np.array(at)) if where else most

    def _logit(self, most: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        act = np.maximum(most + self.p["bias"], 0)
        seen = np.concatenate([act.mean(0), act.max(0)])
        return float(seen @ self.p["out"] + self.p["base"][0]), act, seen

    def score(self, texts: list[str]) -> np.ndarray:
        logits = np.array([self._logit(self._pooled(self._bytes(t)))[0] for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def fit(self, texts: _labelled.Texts | list[str], y: np.ndarray | None = None, epochs: int = 6, batch: int = 16, steps: int = 1200, rate: float = 0.01, seed: int = 0) -> ByteConvNet:
        """Adam on the log loss, for ``epochs`` epochs and ``steps`` steps at least; the gradient of a maximum goes to the window
        that reached it. Texts in a list come with their labels ``y``."""
        if not len(texts):
            return self
        y, read = (texts.y, texts.read) if y is None else (y, lambda order: ((texts[i], y[i]) for i in order))
        epochs = max(epochs, -(-steps * batch // len(y)))
        rng = np.random.default_rng(seed)
        share = min(max(float(y.mean()), 0.01), 0.99)
        self.p["base"][0] = np.log(share / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        filters, step = len(self.p["bias"]), 0
        each = np.arange(filters)
        for epoch in range(epochs):
            rows = read(rng.permutation(len(y)))
            for _ in range(0, len(y), batch):
                g = {n: np.zeros_like(x) for n, x in self.p.items()}
                for text, label in islice(rows, batch):
                    x = self._bytes(text)
                    most, at = self._pooled(x, where=True)
                    logit, act, seen = self._logit(most)
                    d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / batch
                    g["base"] += d
                    g["out"] += d * seen
                    back = np.repeat((d * self.p["out"][:filters] / len(act))[None], len(act), 0)
                    back[act.argmax(0), each] += d * self.p["out"][filters:]
                    back *= act > 0
                    g["bias"] += back.sum(0)
                    for o in range(self.width):
                        np.add.at(g["table"][o], (x[at + o], each[None]), back)
                step += 1
                lr = rate * (1 - epoch / epochs)
                for n, x in self.p.items():
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                    x -= lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8) + (1e-4 * lr * x if n == "table" else 0)
        return self


def _net(docs: DataFrame, labels: DataFrame, train_rows: int, held_chars: int, id_col: str, text_col: str, label_col: str):
    texts = _labelled.Texts(_labelled.sample(docs, labels, label_col, train_rows, id_col=id_col, text_col=text_col), held_chars)
    return docs.sparkSession.sparkContext.broadcast(ByteConvNet().fit(texts)), len(texts)


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = 4096, held_chars: int = 100_000_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; see score_quality(). All rows if no label can be learnt from."""
    net, learnt = _net(docs, labels, train_rows, held_chars, id_col, text_col, label_col)
    if not learnt:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(net.value.score([t or "" for t in batch.column(at).to_pylist()]) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 4096, held_chars: int = 100_000_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher: better), predicted (1 if score >= ``threshold``).

    The network learns on the driver from the whole texts of at most ``train_rows`` labelled documents, of which ``held_chars`` characters are
    held there at most and more are fetched in pieces, whose id's crc32 modulo 5 is not 0; every whole text is scored. Null and empty texts are scored as one window of padding.
    Without labels every score is what the untrained network gives. Repeated rows and other columns don't matter.
    """
    net, _ = _net(docs, labels, train_rows, held_chars, id_col, text_col, label_col)
    return _labelled.scored(docs, lambda: net.value.score, threshold, id_col=id_col, text_col=text_col)
