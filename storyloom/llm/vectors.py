"""Block-wise search of vectors: what the approximate and the exact nearest-neighbour operators share.

Candidates are dealt into shards and queries into blocks of bounded size; each (shard, block) is one task's work, so no
task and no driver ever holds all of either side. The best of each shard are then ranked for each query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import shipped

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 16_384, 8_192

#: (candidate ids, candidates, query ids, queries) to (query number, candidate number) of those that may be among the k best.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def usable(vector: Column, zero: bool) -> Column:
    """Whether a vector takes part: not null nor empty, all components finite, and not zero where zero is False."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = vector.isNotNull() & (F.size(vector) > 0) & finite
    return F.coalesce(found if zero else found & F.exists(vector, lambda x: x != 0), F.lit(False))


def sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added up from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists are of one length as a matrix of doubles."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their query: higher scores first, ties to smaller ids."""
    order = np.lexsort((vec, -score, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def without_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Which rows, sorted by id, can be among anyone's k best: of equal vectors those of the k + 1 smallest ids."""
    rows = np.ascontiguousarray(x + 0.0)  # no negative zeros
    group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8)))[:, 0], return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(order)) - first <= k])


def nearest(vectors: DataFrame, every: int, k: int, search: Search, score: str, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for each id divisible by `every`; rows that repeat count once.

    vectors holds usable vectors only. Vectors of other lengths than the query's are no candidates.
    """
    shipped(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    rows = rows.dropDuplicates().withColumn("dim", F.size("v"))
    n = vectors.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n // every // BLOCK))
    part = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.withColumn("shard", part(shards, 1)).withColumn("block", all_of(blocks))
    right = rows.where(F.pmod("id", F.lit(every)) == 0).withColumn("block", part(blocks, 2)).withColumn("shard", all_of(shards))

    def work(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, own = (t.column("id").to_numpy() for t in (candidates, queries))
        empty = np.zeros(0, np.int64)
        q, c, s = empty, empty, np.zeros(0)
        if len(ids) and len(own):
            order = np.argsort(ids, kind="stable")
            ids, x, y = ids[order], matrix(candidates.column("v"))[order], matrix(queries.column("v"))
            some = without_copies(ids, x, k)
            ids, x = ids[some], x[some]
            nr, at = search(ids, x, own, y)
            differs = own[nr] != ids[at]
            nr, at = nr[differs], at[differs]
            s, q, c = sequential(y[nr], x[at]), own[nr], ids[at]
            keep = best(q, c, s, k)
            q, c, s = q[keep], c[keep], s[keep]
        return pa.table({"query_id": q, "vec_id": c, "value": s})

    key = ["dim", "shard", "block"]
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(work, "query_id long, vec_id long, value double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.expr(score).alias("score"))


def floors(vector: Column) -> Column:
    """floor(64 * x) of each component, x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 64).cast("double"))
