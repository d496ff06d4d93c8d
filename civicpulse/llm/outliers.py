"""Quality rules and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import exp, lgamma, log
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, even_join, hot_keys, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The coordinates with the least spread each is given.  Most texts have no symbols and no
#: repeats, so half of a group can have no spread at all there; without a floor any first
#: symbol would be an outlier.
FLOORS = {"x_words": 0.5, "x_length": 0.08, "x_symbols": 0.05, "x_lines": 0.15, "x_repeats": 0.12}
AXES = tuple(FLOORS)
#: Steps of the distance histogram that finds the nearest half.
BIN = 0.02
BINS = 2000
#: Starts of the concentration steps.
STARTS = 3


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts of ``COUNTS`` for one text."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    letters = int(np.count_nonzero((data & 0xC0) != 0x80)) - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeats, n = 0, len(words)
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, count=n)
        # Number word pairs first, so that triples fit into 64 bits for any text.
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, place, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = (count[place] > 1).astype(np.int64)
        covered = np.zeros(n, np.int64)
        for shift in range(3):
            covered[shift:shift + n - 2] |= twice
        repeats = int(covered.sum())
    return n, letters, symbols, len(lines) - len(set(lines)), repeats


def statistics(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The ``keys`` and the counts of each text; null texts have no words."""
    schema = T.StructType([*[docs.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in (*COUNTS, "n_lines")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts(batch.column(len(keys))):
                found.append((*text_counts(text), 1 + text.count(b"\n")))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], *columns], names=schema.names)

    return docs.select(*keys, "text").mapInArrow(run, schema)


def coordinates() -> list[Column]:
    """The counts as coordinates of comparable spread."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p("n_words").alias("x_words"), F.log1p(F.col("word_chars") / words).alias("x_length"),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x_repeats")]


def chi_square(quantile: float, degrees: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    part = 2 / (9 * degrees)
    return degrees * (1 - part + NormalDist().inv_cdf(quantile) * part ** 0.5) ** 3


def chi_square_share(x: float, degrees: int) -> float:
    """Distribution function of the chi-square distribution (series of the lower gamma function)."""
    a, z = degrees / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= z / (a + n)
        total += term
    return total * exp(a * log(z) - z - lgamma(a)) if z > 0 else 0.0


def consistency(share: float, degrees: int) -> float:
    """By how much the covariance of the nearest ``share`` of a normal sample is too narrow."""
    return 1.0 if share >= 1 else share / chi_square_share(chi_square(share, degrees), degrees + 2)


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products of each group."""
    sums = [F.sum(a).alias(f"s_{i}") for i, a in enumerate(AXES)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(AXES) for j, b in enumerate(AXES) if j >= i]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def shapes(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the mean and the inverse covariance, as arrays of doubles, and the logarithm of
    the covariance's determinant."""
    size = len(AXES)
    floors = np.array(list(FLOORS.values()))
    schema = T.StructType([
        *[sums.schema[k] for k in keys], T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("volume", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, means, inverses, volumes = batch.to_pylist(), [], [], []
            for row in rows:
                mean = np.array([row[f"s_{i}"] for i in range(size)]) / row["n"]
                spread = np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) / row["n"]
                spread = spread - np.outer(mean, mean) + np.diag(floors ** 2)
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(spread).ravel().tolist())
                volumes.append(float(np.linalg.slogdet(spread)[1]))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(means, lists), pa.array(inverses, lists), pa.array(volumes, pa.float64())], names=schema.names)

    return sums.mapInArrow(run, schema)


def squared_distance() -> Column:
    """Mahalanobis distance of the row's coordinates from ``mean``."""
    away = [F.col(a) - F.col("mean")[i] for i, a in enumerate(AXES)]
    total = F.lit(0.0)
    for i in range(len(AXES)):
        for j in range(len(AXES)):
            total = total + away[i] * away[j] * F.col("inverse")[i * len(AXES) + j]
    return total


def judged(
    docs: DataFrame, share: float = 0.75, rounds: int = 8, quantile: float = 0.9999, least: int = 50,
    repeat_share: int = 50, group_by: tuple[str, ...] = ("lang", "source"), trial: int = 2,
) -> DataFrame:
    """``doc_id, group_by, counts, base_failed, distance, kept`` for each document.

    Base rules: ``n_words < least`` or ``100 * n_repeat_words > repeat_share * n_words``
    fail.  Texts that pass them are judged by their group: the mean and covariance of the
    ``share`` of the group that lies nearest are found by concentration steps, all groups at
    once.  They begin at three starts: around the medians with the median deviations as
    spreads, around the medians with equal spreads, and with the moments of the whole group.
    After ``trial`` steps the start of least determinant goes on, ``rounds`` steps in all.  A
    text is kept if its squared distance, corrected for the share, is within the chi-square
    ``quantile``.  ``FLOORS`` are added to the spreads, so a group of one or of equal texts
    keeps them all.

    Null texts have no words and fail the base rules.  Null languages and sources are groups
    of their own; null and repeated ids keep a row each; other columns are not read.
    """
    store, keys = Store(docs.sparkSession, "outliers"), [f"g{i}" for i in range(len(group_by))]
    named = [F.coalesce(F.concat(F.lit("s"), F.col(g).cast("string")), F.lit("n")).alias(k) for g, k in zip(group_by, keys)]
    rows = statistics(docs.select("doc_id", *group_by, "text"), ("doc_id", *group_by))
    failed = (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))
    rows = store.put(rows.select("*", *named, *coordinates(), failed.alias("base_failed")))
    good = rows.where(~F.col("base_failed"))
    counts = store.put(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    hot = hot_keys(counts, keys, "n")

    def concentrated(shape: DataFrame, by: list[str]) -> DataFrame:
        """One step: the shape of the share of each group that lies nearest to its shape."""
        held = good if by == keys else good.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)])))
        most = hot if by == keys else hot_keys(counts.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)]))), by, "n")
        step = F.least(F.floor(F.log1p(squared_distance()) / BIN), F.lit(BINS)).cast("int")
        binned = even_join(held, shape.drop("volume"), by, most).withColumn("bin", step)
        # The nearest share by a histogram of distances: exact counts, bounded rows.
        table = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"))
        lists = table.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("bins"), F.sum("c").alias("all"))
        # The first bin at which the running count reaches the share.
        reached = F.aggregate(
            "bins", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("bin")),
            lambda s, b: F.when(s["sum"] >= F.col("all") * share, s).otherwise(
                F.struct((s["sum"] + b["c"]).alias("sum"), b["bin"].alias("bin"))), lambda s: s["bin"])
        limits = lists.select(*by, reached.alias("limit"))
        inside = even_join(binned.drop("mean", "inverse"), limits, by, most).where("bin <= limit")
        return store.put(shapes(moments(inside, by), by))

    middle = good.groupBy(*keys).agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in AXES])
    near = even_join(good, middle, keys, hot)
    wide = near.groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 1000).alias(f"d_{a}") for a in AXES])
    center = F.array(*[F.col(f"m_{a}") for a in AXES])

    def diagonal(weights: list[Column]) -> Column:
        return F.array(*[weights[i] if i == j else F.lit(0.0) for i in range(len(AXES)) for j in range(len(AXES))])

    scaled = [1 / (F.pow(1.4826 * F.col(f"d_{a}"), F.lit(2)) + f * f) for a, f in FLOORS.items()]
    medians = middle.join(wide, keys)
    starts = medians.select(*keys, F.lit(0).alias("start"), center.alias("mean"), diagonal(scaled).alias("inverse")).unionByName(
        medians.select(*keys, F.lit(1).alias("start"), center.alias("mean"), diagonal([F.lit(1.0)] * len(AXES)).alias("inverse"))).unionByName(
        shapes(moments(good, keys), keys).select(*keys, F.lit(2).alias("start"), "mean", "inverse"))
    shape = store.put(starts)
    for _ in range(trial):
        shape = concentrated(shape, [*keys, "start"])
    best = shape.groupBy(*keys).agg(F.min(F.struct("volume", "start", "mean", "inverse")).alias("best"))
    shape = store.put(best.select(*keys, "best.mean", "best.inverse", "best.volume"))
    for _ in range(rounds - trial):
        shape = concentrated(shape, keys)
    cut = chi_square(quantile, len(AXES)) * consistency(share, len(AXES))
    shape = shape.drop("volume")
    final = even_join(rows, shape, keys, hot, "left").withColumn(
        "distance", F.when(~F.col("base_failed"), squared_distance()))
    return final.select(
        "doc_id", *group_by, *COUNTS, "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"))
