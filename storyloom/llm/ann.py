"""Approximate nearest neighbours by vantage-point trees, one for each shard of the candidates.

Largest inner product becomes least distance by one more component, sqrt(M^2 - |x|^2), which makes all candidates as long as
the longest (M). A node splits its points into the nearer and the farther half from a vantage point, whatever ties there are. A
half is skipped if the query's distance to its edge, times `factor`, exceeds the distance of its k-th best so far: at factor
one that is the triangle inequality, and the search exact; above, more is skipped and some neighbours may be missed. Where
no factor is given, each shard takes the largest one of FACTORS at which a sample of its own points, held against brute
force, finds the share of neighbours asked for: how much can be skipped hangs on the data's dimension.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.vectors import nearest, usable

#: Points of a leaf at most; factors that are tried; points by which a factor is chosen.
LEAF, FACTORS, TRIED = 64, (32.0, 24.0, 16.0, 12.0, 10.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0), 96


class Tree:
    """A vantage-point tree over rows of x."""

    def __init__(self, x: np.ndarray, factor: float = 1.0, leaf: int = LEAF):
        longest = np.sqrt((x * x).sum(axis=1).max())
        extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
        self.x, self.factor, self.leaf = np.hstack([x, extra[:, None]]), factor, leaf
        self.longest, self.visited = longest, 0
        self.root = self._built(np.arange(len(x)), np.random.default_rng(5))

    def _built(self, at: np.ndarray, rng: np.random.Generator):
        """Halves, so that the depth is the logarithm of the points."""
        if len(at) <= self.leaf:
            return at
        # The vantage point whose distances to a sample spread most
        tries = rng.choice(at, 8)
        sample = rng.choice(at, min(len(at), 256))
        spread = [np.linalg.norm(self.x[sample] - self.x[t], axis=1).std() for t in tries]
        vantage = self.x[tries[int(np.argmax(spread))]]
        far = np.linalg.norm(self.x[at] - vantage, axis=1)
        half = len(at) // 2
        order = np.argpartition(far, half)
        inner, outer = order[:half], order[half:]
        edges = float(far[inner].max()), float(far[outer].min())
        return vantage, edges, self._built(at[inner], rng), self._built(at[outer], rng)

    def tuned(self, ids: np.ndarray, k: int, recall: float) -> float:
        """The largest of FACTORS at which a sample of the tree's own points finds `recall` of its k nearest."""
        at = np.random.default_rng(11).permutation(len(ids))[:TRIED]
        y, own = self.x[at, :-1], ids[at]
        score = y @ self.x[:, :-1].T
        score[own[:, None] == ids[None, :]] = -np.inf
        some = min(k, len(ids) - 1)
        if some < 1:
            return FACTORS[-1]
        least = np.partition(score, score.shape[1] - some, axis=1)[:, -some] - 1e-9
        for factor in FACTORS:
            self.factor = factor
            q, c = self.search(own, ids, y, k)
            if (score[q, c] >= least[q]).sum() >= recall * (score >= least[:, None]).sum():
                break
        self.visited = 0
        return self.factor

    def search(self, own: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and candidate numbers of the k best (and any that tie nearly) for rows of y; a query's own id is no candidate."""
        self.y = np.hstack([y, np.zeros((len(y), 1))])
        self.base = (y * y).sum(axis=1) + self.longest**2
        self.own, self.ids, self.k = own, ids, k
        self.top = np.full((len(y), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._visit(self.root, np.arange(len(y)))
        q, c, s = (np.concatenate(z) for z in zip(*self.found, strict=True))
        near = s >= self.top[q].min(axis=1) - 1e-9 * (1 + self.base[q])
        return q[near], c[near]

    def _limit(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.base[q] - 2 * self.top[q].min(axis=1), 0)) + 1e-7

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self.visited += len(q) * len(node)
            for a in range(0, len(q), 1024):
                self._leaf(node, q[a : a + 1024])
            return
        vantage, (inmost, outmost), inner, outer = node
        far = np.sqrt(np.maximum((self.y[q] ** 2).sum(axis=1) - 2 * (self.y[q] @ vantage) + vantage @ vantage, 0))
        within = far < (inmost + outmost) / 2
        near, other = q[within], q[~within]
        self._visit(inner, near)
        across = (outmost - far[within]) * self.factor <= self._limit(near)
        self._visit(outer, np.concatenate([other, near[across]]))
        across = (far[~within] - inmost) * self.factor <= self._limit(other)
        self._visit(inner, other[across])

    def _leaf(self, node: np.ndarray, q: np.ndarray) -> None:
        score = self.y[q, :-1] @ self.x[node, :-1].T
        score[self.own[q][:, None] == self.ids[node][None, :]] = -np.inf
        both = np.hstack([self.top[q], score])
        self.top[q] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        limit = self.top[q].min(axis=1) - 1e-9 * (1 + self.base[q])
        r, c = np.nonzero((score >= limit[:, None]) & (score > -np.inf))
        self.found.append((q[r], node[c], score[r, c]))


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, factor: float | None = None, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found by inner product for each id divisible by `every`.

    factor: how far the pruning is relaxed, 1 for the exact neighbours; None: chosen in each shard for `recall` of them.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Repeated rows
    count once; a row with the query's id is its own. Equal scores go by the smaller id. Fewer candidates than k: all of
    them. An empty table gives an empty result. Other columns are not read.
    """

    def search(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tree = Tree(x, factor or 1.0)
        if factor is None:
            tree.tuned(ids, k, recall)
        return tree.search(own, ids, y, k)

    return nearest(vectors.where(usable(F.col(vector_col), zero=False)), every, k, search, "value", id_col, vector_col)
