"""Hard-negative mining by threshold joins over an inverted index (L2AP).

Rows score against anchors in a fixed order of dimensions, those with most weight first.  A
row's last dimensions are left out of the index where their norm alone cannot lift a score to
the threshold (Cauchy-Schwarz): as each row drops out of the lists after some dimension, lists
sorted by that are prefixes of one order.  Partial scores are accumulated list by list; a pair
is dropped as soon as its partial score and the norms of what remains stay below the
threshold; the survivors are scored in whole.

Thresholds start high and are lowered only for anchors whose windows are not full yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store
from .shards import (
    BLOCK_ROOT, BLOCK_ROWS, SHARD_ROOT, SHARD_ROWS, at_home, dealt, matrix, meet, packed, parts, unpacked, whole)

#: Dimensions of one step; cells of partial scores held at once.
STEP, CELLS = 8, 1 << 22
#: Thresholds for positives as shares of the largest score that an anchor could have.
POSITIVE_SHARES = (0.5, 0.25, 0.12, 0.0)
#: Thresholds for negatives as percents of the positive's score, down to the window's floor.
NEGATIVE_PERCENTS = (75, 55, 40)


class Index:
    """Rows whose dimensions come in ``order``, with the norms of all suffixes."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        self.x, self.order = x[:, order], order
        n, d = x.shape
        self.cuts = [*range(0, d, STEP), d]
        squares = np.cumsum((self.x ** 2)[:, ::-1], axis=1)[:, ::-1]
        # suffix[:, j]: the norm from cut j on; rounding must not make it too small.
        self.suffix = np.concatenate(
            [np.sqrt(squares[:, c:c + 1]) if c < d else np.zeros((n, 1)) for c in self.cuts], axis=1) * (1 + 1e-9)

    def lists(self, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of how many steps of theirs are indexed, most first, and how many
        rows each step's lists hold: later steps are left out where the norm of the rest is
        below ``ratio``."""
        kept = (self.suffix[:, :-1] >= max(ratio, 0)).sum(axis=1) if ratio > 0 else np.full(len(self.x), len(self.cuts) - 1)
        rows = np.argsort(-kept, kind="stable")
        return rows, np.array([(kept > step).sum() for step in range(len(self.cuts) - 1)])

    def above(self, q: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each row of ``q``: its place, and the rows that score ``least`` or more with
        their scores."""
        q = q[:, self.order]
        for start in range(0, len(q), max(1, CELLS // max(1, len(self.x)))):
            some = slice(start, start + max(1, CELLS // max(1, len(self.x))))
            for place, rows, scores in self.block(q[some], least[some]):
                yield start + place, rows, scores

    def block(self, q: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        d = q.shape[1]
        squares = np.cumsum((q ** 2)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([np.sqrt(squares[:, c:c + 1]) if c < d else np.zeros((len(q), 1)) for c in self.cuts], axis=1)
        rest *= 1 + 1e-9
        norm = np.maximum(rest[:, 0], 1e-300)
        rows, sizes = self.lists(float((least / norm).min(initial=np.inf)))
        # Columns of lists are copied once, so that each step reads a prefix.
        x, suffix = self.x[rows], self.suffix[rows]
        partial = np.zeros((len(q), int(sizes[0]) if len(sizes) else 0))
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def drop(first: int, last: int, step: int) -> None:
            """Keep the pairs of rows ``first`` to ``last``, scored up to ``step``, that may pass."""
            bound = partial[:, first:last] + rest[:, step:step + 1] * suffix[first:last, step]
            a, r = np.nonzero(bound >= least[:, None])
            pairs.append((a, r + first, partial[a, r + first], np.full(len(a), step)))

        held = partial.shape[1]
        for step, (start, end) in enumerate(zip(self.cuts, self.cuts[1:])):
            size = int(sizes[step])
            if size < held:
                drop(size, held, step)
                held = size
            if not held:
                break
            partial[:, :held] += q[:, start:end] @ x[:held, start:end].T
        if held:
            drop(0, held, len(self.cuts) - 1)
        a, r, score, step = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in range(4))
        for s in np.unique(step):
            # What the index left out.
            of, cut = np.nonzero(step == s)[0], self.cuts[s]
            for at in range(0, len(of), CELLS // 64):
                part = of[at:at + CELLS // 64]
                score[part] += np.einsum("ij,ij->i", q[a[part], cut:], x[r[part], cut:])
        good = score >= least[a]
        a, r, score = a[good], r[good], score[good]
        by = np.argsort(a, kind="stable")
        a, r, score = a[by], r[by], score[by]
        ends = np.searchsorted(a, np.arange(len(q) + 1))
        for place in range(len(q)):
            part = slice(ends[place], ends[place + 1])
            yield place, rows[r[part]], score[part]


def best_first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def indexed(rows: DataFrame) -> DataFrame:
    """One row for each (dim, shard): ids, labels, vectors and the order of dimensions."""
    def build(key: tuple, group: pa.Table) -> pa.Table:
        x = matrix(group)
        data, kind = packed(x)
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "ids": [np.asarray(group["vec_id"]).tobytes()], "labels": [group["label"].to_pylist()], "x": [data], "kind": [kind],
            "order": [np.argsort(-(x ** 2).sum(axis=0), kind="stable").astype("<i4").tobytes()]})

    schema = "dim int, shard int, ids binary, labels array<string>, x binary, kind string, order binary"
    return rows.select("dim", "shard", "vec_id", "label", "vector").groupBy("dim", "shard").applyInArrow(build, schema)


def loaded(shard: pa.Table, block: pa.Table) -> tuple[Index, np.ndarray, np.ndarray, np.ndarray]:
    """Index, ids and labels of a shard, and the labels of the anchors, as numbers."""
    row = shard.to_pylist()[0]
    ids = np.frombuffer(row["ids"], np.int64)
    x = unpacked(row["x"], row["kind"], len(ids), -1).astype(np.float64)
    number = {label: i for i, label in enumerate(dict.fromkeys(row["labels"]))}
    labels = np.array([number[label] for label in row["labels"]])
    asked = np.array([number.get(label, -1) for label in block["label"].to_pylist()])
    return Index(x, np.frombuffer(row["order"], np.int32)), ids, labels, asked


def positives_of(k: int):
    """Work of one shard with some anchors: ``key, row_id, score``, the best ``k`` of the
    anchor's label.  ``least`` is a score that ``k`` rows are known to reach, or null."""
    def work(shard: pa.Table, block: pa.Table) -> pa.Table:
        index, ids, labels, asked = loaded(shard, block)
        q, keys, owns = matrix(block), np.asarray(block["key"]), np.asarray(block["vec_id"])
        known = np.array([-np.inf if v is None else v for v in block["least"].to_pylist()])
        most = np.linalg.norm(q, axis=1) * index.suffix[:, 0].max(initial=0)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        left = np.arange(len(q))
        for share in (*POSITIVE_SHARES, None):
            goal = known[left] if share is None else np.maximum(known[left], share * most[left])
            open_ = []
            for place, rows, scores in index.above(q[left], goal):
                i = left[place]
                fits = (labels[rows] == asked[i]) & (ids[rows] != owns[i])
                if fits.sum() < k and goal[place] > known[i]:
                    open_.append(i)
                    continue
                rows, scores = rows[fits], scores[fits]
                best = best_first(ids[rows], scores, k)
                out.append((np.full(len(best), keys[i]), ids[rows[best]], scores[best]))
            left = np.array(open_, np.int64)
            if not len(left):
                break
        key, row, score = (np.concatenate([np.empty(0, np.int64), *(o[i] for o in out)]).astype(np.int64) for i in range(3))
        return pa.table({"key": key, "row_id": row, "score": score})
    return work


def negatives_of(k: int):
    """Work of one shard with some anchors: ``key, pos_rank, row_id, score``, the best ``k`` of
    other labels in each open window (``rank``, ``least`` to ``most``) of the anchor."""
    def work(shard: pa.Table, block: pa.Table) -> pa.Table:
        index, ids, labels, asked = loaded(shard, block)
        q, keys, windows = matrix(block), block["key"].to_pylist(), block["windows"].to_pylist()
        goal = np.array([min(w["least"] for w in some) for some in windows], np.float64)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for place, rows, scores in index.above(q, goal):
            other = labels[rows] != asked[place]
            rows, scores = rows[other], scores[other]
            best = np.lexsort((ids[rows], -scores))
            rows, scores = rows[best], scores[best]
            for w in windows[place]:
                # Scores fall, so a window is a stretch.
                first = int(np.searchsorted(-scores, -w["most"], "left"))
                last = min(first + k, int(np.searchsorted(-scores, -w["least"], "right")))
                n = max(0, last - first)
                for column, values in zip(out, ([keys[place]] * n, [w["rank"]] * n, ids[rows[first:first + n]].tolist(),
                                                scores[first:first + n].astype(np.int64).tolist())):
                    column += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("key", "pos_rank", "row_id", "score"), out)})
    return work


def ranked(found: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The best ``k`` of each key with their ``rank``; no key has more than ``k`` for each shard."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: str = "is_anchor", positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, vector`` (array of whole numbers as double), ``label`` and
    ``is_anchor`` (boolean, null: none).  Scores are inner products, exact while sums stay
    below 2^53; higher ones come first, equal ones by the smaller id.  An anchor's positives
    are its best ``positives`` other rows of its label.  For each, the negatives are the best
    ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's
    score (all, if fewer); a negative positive score leaves none.

    Rows with a null id or label, a null or empty vector, or null or non-finite components
    take no part.  Vectors of different lengths do not meet.  Rows that repeat an id are rows
    of their own, but none is its own id's positive or negative; equal anchors are answered
    once.  Anchors without positives, and positives without negatives, have no rows.  Other
    columns are not read.
    """
    store = Store(vectors.sparkSession, "negatives")
    rows = store.put(vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(F.col("vector"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"),
        F.col("label").cast("string").alias("label"), F.coalesce(F.col(is_anchor).cast("boolean"), F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row")))
    n_shards = parts(rows.count(), SHARD_ROWS, SHARD_ROOT)
    placed = dealt(rows, n_shards)
    shards = store.put(indexed(placed))
    asked = store.put(placed.where("asks").groupBy("vec_id", "vector", "label", "dim").agg(F.min("shard").alias("shard")).select(
        F.xxhash64("vec_id", "label", "vector").alias("key"), "vec_id", "vector", "label", "dim", "shard",
        F.lit(None).cast("double").alias("least")))
    n_blocks = parts(asked.count(), BLOCK_ROWS, BLOCK_ROOT)

    schema, work = "key bigint, row_id bigint, score bigint", positives_of(positives)
    home = store.put(at_home(shards, asked, work, schema))
    known = home.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).where(
        F.col("n") >= positives)
    anchors = asked.drop("least", "shard")
    asking = store.put(anchors.join(known.select("key", "least").hint("merge"), "key", "left"))
    near = store.put(ranked(meet(shards, asking, n_shards, n_blocks, work, schema), ("key",), positives))

    # Whole numbers between low and high percent: the same as comparing a hundred times the score.
    p = F.col("score")
    windows = near.select(
        "key", F.col("rank").alias("pos_rank"), F.col("row_id").alias("positive_id"), p.alias("positive_score"),
        F.expr(f"-(({-low} * score - pmod({-low} * score, 100)) div 100)").alias("floor"),
        F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("most"))
    windows = store.put(windows.where("floor <= most"))
    schema, work = "key bigint, pos_rank bigint, row_id bigint, score bigint", negatives_of(negatives)
    open_, done = windows, []
    for percent in (*(p for p in NEGATIVE_PERCENTS if low < p < high), None):
        at = F.col("floor") if percent is None else F.greatest("floor", F.expr(f"{percent} * positive_score div 100"))
        want = open_.select("key", F.struct(
            F.col("pos_rank").alias("rank"), at.cast("double").alias("least"), F.col("most").cast("double").alias("most")).alias("w"))
        wanted = store.put(anchors.join(want.groupBy("key").agg(F.collect_list("w").alias("windows")).hint("merge"), "key"))
        found = store.put(ranked(meet(shards, wanted, n_shards, n_blocks, work, schema), ("key", "pos_rank"), negatives))
        if percent is None:
            done.append(found)
            break
        full = found.where(F.col("rank") == negatives).select("key", "pos_rank")
        done.append(found.join(full.hint("merge"), ["key", "pos_rank"], "left_semi"))
        open_ = store.put(open_.join(full.hint("merge"), ["key", "pos_rank"], "left_anti"))
        if not open_.limit(1).count():
            break
    mined = done[0]
    for more in done[1:]:
        mined = mined.unionByName(more)
    named = windows.drop("floor", "most").join(anchors.select("key", F.col("vec_id").alias("anchor_id")).hint("merge"), "key")
    return mined.join(named.hint("merge"), ["key", "pos_rank"]).select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
