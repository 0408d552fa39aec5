"""Exact top-k inner products by the threshold algorithm over sorted lists, one for each dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm._shared import parked


def scaled(vectors: list, scale: int = 1024) -> list[np.ndarray | None]:
    """floor(scale * x) for each component; None for vectors that are null or hold null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        x = np.floor(scale * np.asarray(v, np.float64))
        out.append(x.astype(np.int64) if np.isfinite(x).all() else None)
    return out


class SortedLists:
    """A block of vectors of one length, with the order of each dimension's values; ``scored`` counts the rows scored so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.v, self.scored = ids, vectors, 0
        self.exact = vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.most = int(np.abs(vectors).max(initial=0))

    def improve(self, query_id: int, q: np.ndarray, best: list[tuple[int, int]], k: int, floor: int | None = None, step: int = 16) -> list[tuple[int, int]]:
        """The k best (-score, id) of ``best`` and this block, without rows of the query's own id and scores below ``floor``.

        The lists of the query's dimensions are read from the end that gives it the larger products, twice as deep each time;
        what is met for the first time is scored in full. No row still unmet can have more than the sum of the products at the
        depth read, so reading stops when the kth score or ``floor`` is above that: a row of just that score could still win
        its tie. When half of the rows are met the others are scored without the lists.
        """
        n = len(self.ids)
        exact = float(self.most) * float(np.abs(q).sum()) < 2.0**53
        v, w = (self.exact, q.astype(np.float64)) if exact else (self.v, q)
        up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
        met, depth = np.zeros(n, bool), 0
        while depth < n:
            end = min(n, max(step, 2 * depth))
            fresh = np.zeros(n, bool)
            if len(up) or len(down):
                fresh[self.order[depth:end, up].ravel()] = True
                fresh[self.order[n - end : n - depth, down].ravel()] = True
            if not (len(up) or len(down)) or 2 * np.count_nonzero(met | fresh) > n:
                fresh[:], end = True, n
            rows = np.flatnonzero(fresh & ~met)
            met[rows] = True
            self.scored += len(rows)
            if len(rows):
                best = self._merge(query_id, rows, (v @ w if len(rows) == n else v[rows] @ w), best, k, floor)
            if end == n:
                break
            bound = int((self.v[self.order[end - 1, up], up] * q[up]).sum()) + int((self.v[self.order[n - end, down], down] * q[down]).sum())
            if (floor is not None and floor > bound) or (len(best) == k and -best[-1][0] > bound):
                break
            depth = end
        return best

    def _merge(self, query_id: int, rows: np.ndarray, scores: np.ndarray, best: list[tuple[int, int]], k: int, floor: int | None) -> list[tuple[int, int]]:
        scores = scores.astype(np.int64)
        least = -best[-1][0] if len(best) == k else floor
        if least is not None:
            some = scores >= max(least, floor if floor is not None else least)
            rows, scores = rows[some], scores[some]
        own = self.ids[rows] == query_id
        if own.any():
            rows, scores = rows[~own], scores[~own]
        if len(rows) > 4 * k:
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[some], scores[some]
        found = [(-s, i) for s, i in zip(scores.tolist(), self.ids[rows].tolist())]
        return sorted(best + found)[:k] if found else best


def _searched(rows: DataFrame, queries: list[tuple[int, np.ndarray]], floors: dict[int, int], k: int, scale: int, block: int) -> tuple[DataFrame, Broadcast]:
    """(number, query_id, score, id): what each task of ``rows`` has to pass on for each query, k rows at most and none below
    the query's floor; and the broadcast, to be let go when that is written."""
    shipped = rows.sparkSession.sparkContext.broadcast((queries, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floors = shipped.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                ids, vs = piece.column("id").to_pylist(), scaled(piece.column("v").to_pylist(), scale)
                for length in sorted({len(v) for v in vs if v is not None}):
                    of = [i for i, v in enumerate(vs) if v is not None and len(v) == length]
                    lists = SortedLists(np.array([ids[i] for i in of], np.int64), np.stack([vs[i] for i in of]))
                    for j, (i, q) in enumerate(asked):
                        if len(q) == length:
                            best[j] = lists.improve(i, q, best[j], k, floors.get(j))
        flat = [(j, q, -s, i) for j, ((q, _), found) in enumerate(zip(asked, best)) for s, i in found]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], ["number", "query_id", "score", "id"])

    return rows.mapInArrow(run, "number long, query_id long, score long, id long"), shipped


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block: int = 16_384, queries_at_once: int = 20_000, first: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query (a row whose id is divisible by ``every``) the ``k`` other rows of largest integer inner product of the
    scaled vectors: query_id, rank (from 1), the id, score. Fewer rows than k give all; ties go to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors of another
    length than the query's are no candidates. Rows with the query's own id are no candidates for it; a query repeated with
    one vector is asked once, one id with two vectors is two queries of that id. A candidate repeated counts as often.
    Other columns are ignored.

    The queries are broadcast ``queries_at_once`` at a time, and one such pass has ended before the next begins. Its first
    search, over one row of ``first``, gives each query a floor, so that the search over all rows stops as early as that
    allows and passes on few rows, however many tasks there are. Blocks of ``block`` rows are searched where they are.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    asked = rows.filter(F.col("id") % every == 0).distinct()
    passes = -(-asked.count() // queries_at_once) or 1
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
    result = None
    for p in range(passes):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).collect()
        queries = sorted(((r.id, q) for r, q in zip(got, scaled([r.v for r in got], scale)) if q is not None), key=lambda x: (x[0], x[1].tolist()))
        few, shipped = _searched(rows.filter(F.pmod(F.xxhash64("id"), F.lit(first)) == 0), queries, {}, k, scale, block)
        floors = {r.number: r.score for r in few.withColumn("rank", place).filter(F.col("rank") == k).select("number", "score").collect()}
        shipped.unpersist()
        found, shipped = _searched(rows, queries, floors, k, scale, block)
        part = parked(found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score"), "top-k")
        shipped.unpersist()
        result = part if result is None else result.unionByName(part)
    return result
