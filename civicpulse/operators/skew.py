"""Joins that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
SALTS = 64
SMALL_ROWS = 10_000


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only for a table counted to be small.

    Above the limit the table is returned without a hint and the join shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = HOT_SHARE) -> DataFrame:
    """Hashes of the keys that hold at least ``share`` of all rows.

    There are at most ``1 / share`` of them, 8 bytes each, so the result is always small.
    """
    total = counts.agg(F.sum(n)).scalar()
    held = F.col(key).isNotNull() & (F.col(n) >= total * share)
    return counts.where(held).select(F.xxhash64(key).alias("hot_hash"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot: DataFrame,
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    salts: int = SALTS,
    hint: str | None = None,
) -> DataFrame:
    """Equi-join on ``key`` that splits hot and null keys of ``left``.

    A left row of a hot key gets one of ``salts`` salts, in turn within its task or from a
    hash of ``spread_by``; rows that are equal get different ones in turn.  The matching right rows are repeated once per salt.  Rows
    with a null key match nothing and are only spread.  ``how`` is inner or left; ``hint``
    names a way of joining.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join repeats right rows: use inner or left")
    marks = F.broadcast(hot.distinct())

    def marked(df):
        return df.join(marks, F.xxhash64(df[key]) == marks["hot_hash"], "left")

    is_hot = F.col("hot_hash").isNotNull()
    number = F.xxhash64(*spread_by) if spread_by else F.monotonically_increasing_id()
    spread = F.pmod(number, F.lit(salts)).cast("int")
    salted_left = marked(left).withColumn(
        "salt", F.when(is_hot | F.col(key).isNull(), spread).otherwise(0)).drop("hot_hash")
    all_salts = F.array(*[F.lit(i) for i in range(salts)])
    salted_right = marked(right).withColumn(
        "salt", F.explode(F.when(is_hot, all_salts).otherwise(F.array(F.lit(0))))
    ).drop("hot_hash")
    if hint:
        salted_right = salted_right.hint(hint)
    return salted_left.join(salted_right, [key, "salt"], how).drop("salt")
