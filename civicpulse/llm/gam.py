"""Quality classifier: an additive model with pairwise interactions, learnt by cyclic boosting."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, texts
from .outliers import text_counts

FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "exclaims", "digits", "stops", "commas", "pipes",
    "repeated_lines", "repeated_words", "distinct_words", "line_words", "other_bytes", "length_spread")
#: Labelled rows that the model is fitted on at most, the first in the order of a hash.
SAMPLE = 30_000
BINS, PAIR_BINS, PAIRS, RATE = 48, 12, 6, 0.1


def features(text: bytes) -> tuple[float, ...]:
    """``FEATURES`` of a text; all zero but for a text without words."""
    n, letters, _, dup_lines, repeats = text_counts(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    some, size = max(n, 1), max(len(text), 1)
    words = text.split()
    lengths = np.fromiter(map(len, words), np.float64, count=n)
    marks = int(count[[35, 36, 37, 38, 42, 60, 62]].sum())
    return (
        float(np.log1p(n)), letters / some, marks / size, int(count[65:91].sum()) / size, int(count[33]) / some,
        int(count[48:58].sum()) / size, int(count[46]) / some, int(count[44]) / some, int(count[124]) / some,
        dup_lines / (1 + int(count[10])), repeats / some, len(set(words)) / some ** 0.8 if n else 0.0,
        n / (1 + int(count[10])), int(count[128:].sum()) / size, float(lengths.std()) if n else 0.0)


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and a column for each feature."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(f, T.DoubleType()) for f in FEATURES]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in texts(batch.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in rows.T]], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Model:
    """Lookup tables: a score is the sum of one entry of each."""
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``: vectorised bin additions."""
        total = np.full(len(x), self.bias)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            a = np.searchsorted(self.pair_edges[i], x[:, i], side="right")
            b = np.searchsorted(self.pair_edges[j], x[:, j], side="right")
            total += table[a, b]
        return 1 / (1 + np.exp(-total))


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.empty(0)


def gains(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best cut of a row of bins and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g ** 2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g ** 2 / (all_h + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of at most four leaves over a row of bins, as one step for each bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        after = []
        for a, b in parts:
            gain, at = gains(g[a:b], h[a:b], ridge)
            after += [(a, a + at), (a + at, b)] if gain > 1e-9 else [(a, b)]
        parts = after
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid in both directions: its gain, and one step for each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        corner, down, right, total = c[:-1, :-1], c[-1:, :-1], c[:-1, -1:], c[-1, -1]
        return [corner, right - corner, down - corner, total - right - down + corner]
    parts = list(zip(quarters(cg), quarters(ch)))
    gain = sum(a ** 2 / (b + ridge) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros(g.shape)
    cells = ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
             (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))
    for cell, (a, b) in zip(cells, parts):
        step[cell] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, ridge: float = 5.0) -> Model:
    """Cyclic boosting: each round gives every feature in turn one small tree on the residuals.

    Then the pairs with the largest interaction left get grids in the same way.  Without both
    labels the model is a constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(bias=float(np.log(share / (1 - share))), edges=[cuts(c, BINS) for c in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(set(y.tolist())) < 2:
        return model
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    total = np.full(len(x), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, at in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[i])
            step = RATE * shallow_tree(np.bincount(at, g, size), np.bincount(at, h, size), ridge)
            model.tables[i] += step
            total += step[at]
    model.pair_edges = [cuts(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, width = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        at = coarse[i] * width + coarse[j]
        return at, np.bincount(at, g, rows * width).reshape(rows, width), np.bincount(at, h, rows * width).reshape(rows, width)

    g, h = slopes()
    found = sorted(((quadrants(*grid(i, j, g, h)[1:], ridge)[0], (i, j)) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [pair for _, pair in found[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            at, grid_g, grid_h = grid(i, j, g, h)
            step = RATE * quadrants(grid_g, grid_h, ridge)[1]
            model.pair_tables[k] += step
            total += step.ravel()[at]
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, store: Store) -> DataFrame:
    """``doc_id, y`` of the labelled documents that the model is fitted on: ``sample`` rows at most.

    They are the first in the order of a hash of the id.  Only ids are joined with the labels,
    and hashes far behind the last one wanted go before the rest is put in order.
    """
    marks = labels.where("quality IN (0, 1)").where(~held_out()).select("doc_id", F.col("quality").cast("double").alias("y")).distinct()
    both = store.put(docs.select("doc_id").join(marks, "doc_id").withColumn("order", F.xxhash64("doc_id", F.lit(3))))
    n = both.count()
    if n > 1.25 * sample:
        both = both.where(F.col("order") < int(2.0 ** 64 * 1.1 * sample / n) - 2 ** 63)
    return store.put(both.orderBy("order", "doc_id", "y").limit(sample).select("doc_id", "y"))


def learnt(rows: DataFrame, few: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labels of ``few`` (see ``sampled``, so its size is bounded) on ``rows`` of features."""
    both = rows.join(F.broadcast(few.distinct()), "doc_id")
    data = both.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "y").limit(sample).select(*FEATURES, "y").toArrow()
    x = np.array([data.column(i).to_numpy() for i in range(data.num_columns)]).T
    return fit(x[:, :-1], x[:, -1]) if len(x) else Model(edges=[np.empty(0)] * len(FEATURES), tables=[np.zeros(1)] * len(FEATURES))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document.

    The score uses the text alone.  Rows whose crc32(doc_id as text) is divisible by five are
    held out: their labels are never read.  The model is fitted in the driver on at most
    ``sample`` labelled rows (the bound of what is gathered: ``sample`` times 16 numbers).

    Null and empty texts are scored like any other, with all features zero.  Labels that are
    null or not 0 or 1 are left out, and one given twice counts once; without labels every
    score is one half.  Null and
    repeated ids keep a row each (a null id is not held out); other columns are not read.
    """
    store = Store(docs.sparkSession, "quality")
    rows = store.put(featured(docs))
    model = docs.sparkSession.sparkContext.broadcast(learnt(rows, sampled(rows, labels, sample, store), sample))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([batch.column(i + 1).to_numpy() for i in range(len(FEATURES))]).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def passing(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents, whole rows, whose score is at least ``threshold``.

    The model is that of ``scored``; texts are scored where they are read, and no text is
    shuffled: the ids of the sample, a bounded number, are sent to the texts.
    """
    store = Store(docs.sparkSession, "quality")
    few = sampled(docs, labels, sample, store)
    marked = docs.select("doc_id", "text").join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(learnt(featured(marked), few, sample))

    def score(column: pd.Series) -> pd.Series:
        rows = [features((t or "").encode()) for t in column]
        return pd.Series(model.value.score(np.array(rows).reshape(-1, len(FEATURES))))

    return docs.where(F.pandas_udf(score, "double")(F.col("text")) >= threshold)
