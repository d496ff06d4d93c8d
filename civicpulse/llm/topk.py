"""Exact top-k inner products by Fagin's threshold algorithm.

Every shard holds one list for each dimension, its rows sorted by that component.  A query
reads all lists downwards at once, from the end where its weight makes scores large.  Rows met
are scored in whole (random access).  What no list has shown yet scores at most the sum of
weight times next value over all lists; when that cannot reach the k-th best score any more,
the query stops.  The k-th score of a query in its own shard bounds it in all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store
from .shards import (
    BLOCK_ROOT, BLOCK_ROWS, SHARD_ROOT, SHARD_ROWS, at_home, dealt, matrix, meet, packed, parts, unpacked, whole)

#: How deep a query reads all lists before it first looks at its bound.
FIRST_DEPTH = 4


class Lists:
    """The rows of a shard and, for each dimension, their places by ascending component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T if order is None else order

    def bound(self, q: np.ndarray, used: np.ndarray, depth: int) -> float:
        """The most that a row can score which no list has shown in its first ``depth`` places."""
        n = len(self.ids)
        if depth >= n:
            return -np.inf
        at = np.where(q[used] > 0, n - 1 - depth, depth)
        return float(q[used] @ self.x[self.order[used, at], used])

    def top(self, q: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best ``k`` rows with another id than ``own`` that score
        ``least`` or more, ties to the smaller id; and how many rows were scored."""
        n, used = len(self.ids), np.nonzero(q)[0]
        up, down = used[q[used] > 0], used[q[used] < 0]
        met = np.zeros(n, bool)
        ids, scores = np.empty(0, np.int64), np.empty(0)
        before, depth, scored = 0, min(n, FIRST_DEPTH if len(used) else n), 0
        while True:
            fresh = np.zeros(n, bool)
            if len(used):
                fresh[self.order[up, n - depth:n - before]] = True
                fresh[self.order[down, before:depth]] = True
            else:
                fresh[:] = True
            fresh &= ~met
            met |= fresh
            new = np.nonzero(fresh)[0]
            scored += len(new)
            found = self.x[new] @ q
            keep = (found >= max(least, scores[-1] if len(scores) == k else -np.inf)) & (self.ids[new] != own)
            ids, scores = np.concatenate((ids, self.ids[new[keep]])), np.concatenate((scores, found[keep]))
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            # A row that ties with the k-th may have a smaller id: only a lower bound ends it.
            goal = max(least, scores[-1] if len(scores) == k else -np.inf)
            if depth >= n or self.bound(q, used, depth) < goal:
                return ids, scores, scored
            before, low, high = depth, depth + 1, n
            if goal > -np.inf:
                # The depth at which this goal ends it; a better one can only come earlier.
                while low < high:
                    middle = (low + high) // 2
                    if self.bound(q, used, middle) < goal:
                        high = middle
                    else:
                        low = middle + 1
                depth = min(low, 4 * depth)
            else:
                depth = min(n, 4 * depth)


def sorted_lists(rows: DataFrame) -> DataFrame:
    """One row for each shard of (dim, shard): ids, vectors and lists."""
    def build(key: tuple, group: pa.Table) -> pa.Table:
        lists = Lists(np.asarray(group["vec_id"]), matrix(group))
        x, kind = packed(lists.x)
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "ids": [lists.ids.tobytes()], "x": [x], "kind": [kind], "order": [lists.order.astype("<u4").tobytes()]})

    schema = "dim int, shard int, ids binary, x binary, kind string, order binary"
    return rows.select("dim", "shard", "vec_id", "vector").groupBy("dim", "shard").applyInArrow(build, schema)


def searched(k: int):
    """Work of one shard with some queries: ``key, query_id, vec_id, score``."""
    def work(shard: pa.Table, block: pa.Table) -> pa.Table:
        row = shard.to_pylist()[0]
        ids = np.frombuffer(row["ids"], np.int64)
        x = unpacked(row["x"], row["kind"], len(ids), -1).astype(np.float64)
        lists = Lists(ids, x, unpacked(row["order"], "<u4", -1, len(ids)))
        keys, owns, least = (block[c].to_pylist() for c in ("key", "vec_id", "least"))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for key, own, bound, q in zip(keys, owns, least, matrix(block)):
            near, scores, _ = lists.top(q, own, k, -np.inf if bound is None else bound)
            for column, values in zip(out, ([key] * len(near), [own] * len(near), near.tolist(), scores.astype(np.int64).tolist())):
                column += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("key", "query_id", "vec_id", "score"), out)})
    return work


def top_k(vectors: DataFrame, is_query: str = "is_query", k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each query (all, if fewer).

    ``vectors`` has ``vec_id, vector`` (array of whole numbers as double) and ``is_query``
    (boolean, null: none).  Scores are inner products, exact while sums stay below 2^53; equal
    scores go to the smaller id.  A query meets all rows but those of its own id.

    Rows with a null id, a null or empty vector, or null or non-finite components take no
    part.  Vectors of different lengths do not meet.  Rows that repeat an id are rows of their
    own; equal queries are answered once, and different queries of one id each.  No queries or
    no rows give no rows; other columns are not read.
    """
    store = Store(vectors.sparkSession, "topk")
    rows = store.put(vectors.where(F.col("vec_id").isNotNull() & whole(F.col("vector"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"),
        F.coalesce(F.col(is_query).cast("boolean"), F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    n_shards = parts(n, SHARD_ROWS, SHARD_ROOT)
    placed = dealt(rows, n_shards)
    shards = store.put(sorted_lists(placed))
    key = F.xxhash64("vec_id", "vector").alias("key")
    asked = placed.where("asks").groupBy("vec_id", "vector", "dim").agg(F.min("shard").alias("shard")).select(
        key, "vec_id", "vector", "dim", "shard", F.lit(None).cast("double").alias("least"))
    asked = store.put(asked)
    n_blocks = parts(asked.count(), BLOCK_ROWS, BLOCK_ROOT)
    schema = "key bigint, query_id bigint, vec_id bigint, score bigint"
    # At home first: the k-th best score there is the least that counts elsewhere.
    work = searched(k)
    home = store.put(at_home(shards, asked, work, schema))
    bounds = home.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
    asking = store.put(asked.drop("least", "shard").join(bounds.select("key", "least").hint("merge"), "key", "left"))
    found = store.put(meet(shards, asking, n_shards, n_blocks, work, schema))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

