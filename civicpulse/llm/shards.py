"""Vectors in shards, and queries in blocks that meet every shard.

All rows of a table against a stated set of queries is work in blocks: each shard of rows is
indexed once and stored, each block of queries meets each shard once.  Both sizes grow with
the square root of what they divide, so neither the number of meetings nor the memory of one
grows with the rows alone.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard: at least, at most, and what is multiplied with all rows under the root.
SHARD_ROWS, SHARD_ROOT = (1024, 1 << 18), 512
#: The same of a block of queries.
BLOCK_ROWS, BLOCK_ROOT = (256, 1 << 14), 256


def integers(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component ``x``, taken as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def whole(vector: Column) -> Column:
    """Whether a vector is there with all its components, and they are finite."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def parts(n: int, rows: tuple[int, int], root: int) -> int:
    """Into how many parts ``n`` rows go."""
    return max(1, ceil(n / min(rows[1], max(rows[0], ceil(sqrt(n * root))))))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Stored ``rows`` with ``dim`` and ``shard``: dealt by their number, so copies spread."""
    return rows.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))


def packed(x: np.ndarray) -> tuple[bytes, str]:
    """An array in as few bytes as its whole numbers allow."""
    for kind in ("<i2", "<i4"):
        info = np.iinfo(kind)
        if not x.size or (x.min() >= info.min and x.max() <= info.max):
            return x.astype(kind).tobytes(), kind
    return x.astype("<f8").tobytes(), "<f8"


def unpacked(data: bytes, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(*shape)


def matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    lists = table[column].combine_chunks()
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def both(work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``work`` where a shard meets queries; no rows where either is missing."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        return work(shard, block) if len(shard) and len(block) else pa.table({c: pa.array([], pa.int64()) for c in names})
    return run


def at_home(shards: DataFrame, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` of each shard with the queries dealt to it (dim, shard)."""
    return shards.groupBy("dim", "shard").cogroup(queries.groupBy("dim", "shard")).applyInArrow(both(work, schema), schema)


def meet(shards: DataFrame, queries: DataFrame, n_shards: int, n_blocks: int, work: Callable, schema: str) -> DataFrame:
    """``work(shard, block)`` for each shard and each block of queries of its dimension.

    ``shards`` has one row for each (dim, shard); ``queries`` has ``key`` and ``dim``; all
    columns of ``schema`` are whole numbers.
    """
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    keys = ("dim", "shard", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both(work, schema), schema)
