"""Exact top-k by inner product with pivot-table elimination.

One more component, sqrt(M^2 - |x|^2), makes all candidates as long as the longest, so that a larger inner product is a lesser
distance. Distances of all candidates to many pivots are computed once. For a query, the largest difference of its own and
a candidate's distance to a pivot bounds their distance from below, and so the score from above. Candidates are
evaluated in the order of their bounds; a query is done when no bound left reaches its k-th score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.vectors import floors, nearest, usable

#: Pivots of a shard; candidates evaluated first for each query; then at a time; queries that are bounded together.
PIVOTS, FIRST, STEP, TOGETHER = 24, 128, 4096, 64


class PivotTable:
    """Distances of rows of x to pivots, of which each is the farthest from those before it."""

    def __init__(self, x: np.ndarray, pivots: int = PIVOTS):
        self.x, squares = x, (x * x).sum(axis=1)
        self.longest = squares.max()
        self.extra = np.sqrt(np.maximum(self.longest - squares, 0))
        self.pivots: list[np.ndarray] = []
        table, least, at = [], np.full(len(x), np.inf), 0
        for _ in range(min(pivots, len(x))):
            pivot = np.append(x[at], self.extra[at])
            far = np.sqrt(np.maximum(squares + self.extra**2 + pivot @ pivot - 2 * (x @ pivot[:-1] + self.extra * pivot[-1]), 0))
            self.pivots.append(pivot)
            table.append(far)
            least = np.minimum(least, far)
            at = int(np.argmax(least))
        self.table = np.array(table, dtype=np.float32)
        self.evaluated = 0

    def search(self, ids: np.ndarray, own: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and candidate numbers of all that score at least as the k-th best, for rows of y."""
        pivots = np.array(self.pivots)
        squares = (y * y).sum(axis=1)
        far = np.sqrt(np.maximum(squares[:, None] + (pivots**2).sum(axis=1) - 2 * y @ pivots[:, :-1].T, 0)).astype(np.float32)
        order = np.argsort(far.argmin(axis=1), kind="stable")
        out = [self._together(ids, own[q], y[q], squares[q], far[q], k, q) for a in range(0, len(y), TOGETHER) if len(q := order[a : a + TOGETHER])]
        q, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return q, c

    def _together(self, ids: np.ndarray, own: np.ndarray, y: np.ndarray, squares: np.ndarray, far: np.ndarray, k: int, nr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(self.x), np.arange(len(y))[:, None]
        low = np.zeros((len(y), n), np.float32)
        for p in range(len(self.table)):
            np.maximum(low, np.abs(self.table[p] - far[:, p, None]), out=low)
        scale = 1e-4 * (1 + float(np.sqrt(self.longest + squares.max())))  # more than the rounding of the distances
        bound = (squares[:, None] + self.longest - np.maximum(low - scale, 0).astype(np.float32) ** 2) / 2 + 1e-3 * scale
        bound[own[:, None] == ids[None, :]] = -np.inf
        first = np.argpartition(-bound, min(FIRST, n - 1), axis=1)[:, :FIRST]
        score = np.einsum("qcd,qd->qc", self.x[first], y)
        score[bound[rows, first] == -np.inf] = -np.inf
        top = np.full((len(y), k), -np.inf)
        top = np.partition(np.hstack([top, score]), score.shape[1], axis=1)[:, -k:]
        self.evaluated += score.size
        found = [(np.repeat(rows[:, 0], first.shape[1]), first.ravel(), score.ravel())]
        bound[rows, first] = -np.inf
        # The others by the best of their bounds, as long as one of the queries needs one
        best = bound.max(axis=0)
        needed = np.flatnonzero((bound >= top.min(axis=1)[:, None]).any(axis=0) & (best > -np.inf))
        needed = needed[np.argsort(-best[needed], kind="stable")]
        for a in range(0, len(needed), STEP):
            at = needed[a : a + STEP]
            if best[at[0]] < top.min():  # no bound left reaches any query's k-th score
                break
            at = at[((bound[:, at] >= top.min(axis=1)[:, None]) & (bound[:, at] > -np.inf)).any(axis=0)]
            if not len(at):
                continue
            score = y @ self.x[at].T
            score[bound[:, at] < top.min(axis=1)[:, None]] = -np.inf
            score[bound[:, at] == -np.inf] = -np.inf
            self.evaluated += score.size
            top = np.partition(np.hstack([top, score]), score.shape[1], axis=1)[:, -k:]
            r, c = np.nonzero((score >= top.min(axis=1)[:, None]) & (score > -np.inf))
            found.append((r, at[c], score[r, c]))
        q, c, s = (np.concatenate(z) for z in zip(*found, strict=True))
        keep = (s >= top.min(axis=1)[q]) & (s > -np.inf)
        return nr[q[keep]], c[keep]


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of floor(64 * x) for each id divisible by `every`.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; zero vectors do.
    Repeated rows count once; a row with the query's id is its own. Equal scores go by the smaller id. Fewer candidates
    than k: all of them. An empty table gives an empty result. Other columns are not read.
    """

    def search(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return PivotTable(x).search(ids, own, y, k)

    vectors = vectors.where(usable(F.col(vector_col), zero=True)).select(id_col, floors(F.col(vector_col)).alias(vector_col))
    return nearest(vectors, every, k, search, "cast(value as long)", id_col, vector_col)
