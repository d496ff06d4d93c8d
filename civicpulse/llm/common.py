"""Shared pieces of the operators: tables, words, stored intermediate results, even joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir

#: What separates words in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Store:
    """Tables written under the shared folder, so that lost executors cost no recomputation.

    ``put`` writes a table and reads it back.  ``drop`` deletes a table that nothing needs
    any more.  The tables behind a returned DataFrame stay until the caller deletes ``path``.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.path, self.used = spark, run_dir(spark, purpose), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.used += 1
        where = f"{self.path}/{self.used}"
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.stored_at = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(conf).delete(path, True)


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of all rows counted in ``n``: at most 1 / share rows.

    Where there are no more keys than that, all of them.
    """
    if len(counts.limit(int(1 / share) + 1).select(n).collect()) <= 1 / share:
        out = counts.select(*keys)
        out.all_keys = True
        return out
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) >= max(2.0, total * share)).select(*keys)


def even_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` with a ``right`` that has each key once, even if keys are hot.

    Rows of ``right`` under the ``hot`` keys (few by construction, see ``hot_keys``) are
    broadcast; the rest is an ordinary join in which no key of ``left`` holds many rows, as
    the hot and null keys of ``left`` are moved to keys of their own.  ``how``: inner, left.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    few = right.join(F.broadcast(hot), keys, "left_semi").select(
        *keys, F.struct(*values).alias("_hot"))
    marked = left.join(F.broadcast(few), keys, how if getattr(hot, "all_keys", False) else "left")
    columns = [F.col(c) for c in left.columns]
    if getattr(hot, "all_keys", False):
        return marked.select(*columns, *[F.col(f"_hot.{c}").alias(c) for c in values])
    # Hot and null keys find nothing in the second join; random numbers of their row spread them.
    alone = F.col("_hot").isNotNull()
    for key in keys:
        alone = alone | F.col(key).isNull()
    salt = F.when(alone, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(100_003))).otherwise(0)
    rest = right.join(F.broadcast(hot), keys, "left_anti").select(
        *keys, F.struct(*values).alias("_rest"), F.lit(0).cast("bigint").alias("_salt"))
    joined = marked.withColumn("_salt", salt.cast("bigint")).join(rest, [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_rest")
    if how == "inner":
        joined = joined.where(F.coalesce(F.col("_hot").isNotNull(), F.lit(False)) | F.col("_rest").isNotNull())
    return joined.withColumn("_found", found).select(*columns, *[F.col(f"_found.{c}").alias(c) for c in values])


def row_key() -> list[Column]:
    """Two 64-bit hashes that tell a row of (doc_id, text) from another; equal rows share them."""
    return [F.xxhash64("doc_id", F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2")]


# ---- inside tasks ------------------------------------------------------------------

def texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hashes(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of every run of ``length`` neighbours, by doubling."""
    if len(x) < length:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        done, size, out = 0, 1, None
        power, part = np.uint64(base), x
        n = len(x) - length + 1
        while True:
            if length & size:
                piece = part[done:done + n]
                out = piece if out is None else out * power + piece
                done += size
            if done == length:
                return mix(out)
            part = part[:-size] * power + part[size:]
            power, size = power * power, size * 2


def sliding_min(x: np.ndarray, length: int) -> np.ndarray:
    """The least of every ``length`` neighbours, by doubling."""
    n, size, part = len(x) - length + 1, 1, x
    if n <= 0:
        return np.empty(0, x.dtype)
    while size * 2 <= length:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return np.minimum(part[:n], part[length - size:length - size + n])


class Hashes(dict):
    """64-bit hashes of byte strings, remembered up to ``most`` entries."""

    def __init__(self, seed: int, most: int = 300_000):
        from xxhash import xxh64_intdigest
        self.hash, self.seed, self.most = xxh64_intdigest, seed, most

    def __missing__(self, key: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.hash(key, self.seed)
        return value

    def of(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, count=len(items))
