"""Winnowing: guaranteed fingerprints of long enough common runs, for lines and for words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, even_join, hot_keys, sliding_min

#: A fingerprint with the windows that chose it: first, last, and how often it counts.
RUN = T.StructType([
    T.StructField("a", T.LongType()), T.StructField("first", T.IntegerType()),
    T.StructField("last", T.IntegerType()), T.StructField("w", T.IntegerType())])
#: Longest run in windows; longer ones are cut, each piece with the same fingerprint.
LONGEST = 32


def runs(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all windows of ``window`` grams: the least gram of each.

    Neighbouring windows with one fingerprint form a run.  Equal windows choose equal
    fingerprints, so a window that occurs twice has a fingerprint that does.  A fingerprint
    that occurs twice in its own text counts double, as both may be within one run.
    """
    least = sliding_min(grams, window)
    if not len(least):
        empty = np.empty(0, np.int32)
        return np.empty(0, np.int64), empty, empty, empty
    change = np.nonzero(least[1:] != least[:-1])[0] + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change - 1, [len(least) - 1]))
    while (last - first).max() >= LONGEST:
        long = last - first >= LONGEST
        middle = first[long] + LONGEST
        first, last = np.concatenate((first, middle)), np.concatenate((np.where(long, first + LONGEST - 1, last), last[long]))
    chosen = least[first]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    weight = 1 + (np.isin(chosen, twice) if len(twice) else np.zeros(len(chosen), bool))
    return chosen.view(np.int64), first.astype(np.int32), last.astype(np.int32), weight.astype(np.int32)


def recurring(rows: DataFrame, store: Store, keys: tuple[str, ...] = ("k1", "k2")) -> DataFrame:
    """Per text (``keys``) the runs whose fingerprint occurs more than once in all texts.

    ``rows`` has ``keys`` and ``runs``.  Counts are summed before they are shuffled; positions
    meet the counts evenly, however often a fingerprint occurs.
    """
    each = rows.select(*keys, F.explode("runs").alias("run"))
    counts = store.put(each.groupBy("run.a").agg(F.sum("run.w").alias("n")).where("n > 1"))
    met = even_join(each.select(*keys, "run.a", "run.first", "run.last"), counts, ["a"], hot_keys(counts, ["a"], "n"))
    return met.groupBy(*keys).agg(F.collect_set(F.struct("a", "first", "last", "n")).alias("hits"))
