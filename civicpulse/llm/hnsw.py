"""Embedding near-duplicates with a small-world graph for each shard.

Shards hold a bounded number of vectors.  Each shard's graph is built once and stored; every
shard is then searched with the vectors of every shard of its label.  Searches of a block of
vectors go on in step, so each step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, even_join, hot_keys
from .components import components

#: Vectors of a shard on average; links of a node before and after pruning; first beam.
PER_SHARD, WIDE, DEGREE, BEAM = 6000, 48, 24, 48
#: Vectors that are searched in step, and those that a shard is audited with at a time.
BLOCK, AUDIT = 256, 512
#: Share of the audited links that the graph must find; else all beams are widened.
RECALL = 0.999
#: True links that an audit must have seen before its recall counts.
EVIDENCE = 50


def top(sims: np.ndarray, size: int) -> np.ndarray:
    """Places of the ``size`` largest of each row, largest first."""
    if sims.shape[1] > size:
        some = np.argpartition(-sims, size - 1, axis=1)[:, :size]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, 1), axis=1), 1)
    return np.argsort(-sims, axis=1)


class Graph:
    """A hierarchical navigable small world of unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.entry = vectors.astype(np.float32), entry
        if layers is not None:
            self.layers = layers
            return
        n = len(vectors)
        level = np.minimum(np.random.default_rng(seed).geometric(1 - 1 / DEGREE, n) - 1, 5)
        self.layers = [np.full((n, WIDE), -1, np.int32) for _ in range(int(level.max(initial=0)) + 1)]
        order, done = np.argsort(-level, kind="stable"), 1
        self.entry = int(order[0]) if n else 0
        while done < n:
            batch = order[done:done + min(BLOCK, max(1, done // 2))]
            self.insert(batch, level[batch], order[:done], level)
            done += len(batch)

    def insert(self, batch: np.ndarray, level: np.ndarray, before: np.ndarray, levels: np.ndarray) -> None:
        """Link new nodes, highest levels first, to the graph and to each other."""
        q, entries = self.x[batch], np.full((len(batch), 1), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            members = level >= layer
            if levels[self.entry] < layer:
                continue
            ids, sims = self.search_layer(q, entries, BEAM, layer)
            entries = ids[:, :8]
            if not members.any():
                continue
            some, own = batch[members], q[members]
            mutual = own @ own.T
            mutual[np.tril_indices(len(some))] = -2  # each pair once, the later links to the earlier
            ids = np.concatenate((ids[members], np.broadcast_to(some, mutual.shape)), axis=1)
            sims = np.concatenate((sims[members], mutual.T), axis=1)
            best = top(sims, BEAM)
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            for node, near, sim in zip(some.tolist(), ids, sims):
                near = near[(sim > -2) & (near >= 0)]
                chosen = self.diverse(near, self.x[node], DEGREE // 2)
                self.layers[layer][node, :len(chosen)] = chosen
                for other in chosen.tolist():
                    self.link(layer, other, node)

    def link(self, layer: int, node: int, other: int) -> None:
        row = self.layers[layer][node]
        free = int(np.searchsorted(row < 0, True))
        if free < WIDE:
            row[free] = other
            return
        near = np.append(row, np.int32(other))
        near = near[np.argsort(-(self.x[near] @ self.x[node]), kind="stable")]
        chosen = self.diverse(near, self.x[node], DEGREE)
        row[:] = -1
        row[:len(chosen)] = chosen

    def diverse(self, near: np.ndarray, center: np.ndarray, size: int) -> np.ndarray:
        """Of the neighbours, nearest first, those nearer to the center than to one taken
        before; then the nearest of the others."""
        if len(near) <= size:
            return near
        to_center = self.x[near] @ center
        mutual = self.x[near] @ self.x[near].T
        taken, covered = [], np.full(len(near), -2.0, np.float32)
        for i in range(len(near)):
            if covered[i] <= to_center[i]:
                taken.append(i)
                if len(taken) == size:
                    break
                np.maximum(covered, mutual[i], out=covered)
        if len(taken) < size:
            rest = np.setdiff1d(np.arange(len(near)), taken, assume_unique=True)
            taken += rest[:size - len(taken)].tolist()
        return near[taken]

    def search_layer(self, q: np.ndarray, entries: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all rows of ``q`` in step: ids and similarities, best first."""
        links, x, rows = self.layers[layer], self.x, np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        sims, opened = np.full((len(q), beam), -np.inf, np.float32), np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), len(x) + 1), bool)  # the last column takes the empty links
        seen[:, -1] = True
        entries, few = entries[:, :beam], max(4, beam // 16)
        fresh = np.where(entries >= 0, entries, -1)
        while len(rows):
            # Leave out what was seen before or twice in one step, then merge into the beam.
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[seen[rows[:, None], fresh]] = -1
            seen[rows[:, None], fresh] = True
            found = np.full(fresh.shape, -np.inf, np.float32)
            at, column = np.nonzero(fresh >= 0)
            found[at, column] = np.einsum("kd,kd->k", x[fresh[at, column]], q[rows[at]])
            all_ids = np.concatenate((ids[rows], fresh), axis=1)
            all_sims = np.concatenate((sims[rows], found), axis=1)
            all_open = np.concatenate((opened[rows], np.zeros(fresh.shape, bool)), axis=1)
            best = top(all_sims, beam)
            ids[rows], sims[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            now_open = np.take_along_axis(all_open, best, 1)
            # Open the first few of each beam that were not opened yet.
            closed = ~now_open & (ids[rows] >= 0)
            first = closed & (np.cumsum(closed, axis=1) <= few)
            opened[rows] = now_open | first
            busy = first.any(axis=1)
            rows, first = rows[busy], first[busy]
            if not len(rows):
                break
            at = np.argsort(~first, axis=1, kind="stable")[:, :few]
            nodes = np.where(np.take_along_axis(first, at, 1), np.take_along_axis(ids[rows], at, 1), -1)
            fresh = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(rows), -1).astype(np.int64)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full((len(q), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            entries = self.search_layer(q, entries, 8, layer)[0]
        return self.search_layer(q, entries, beam, 0)

    def within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of ``q`` the ids that look at least ``least`` similar.

        A beam that is full of them is widened until it holds others too, or all vectors.
        """
        for start in range(0, len(q), BLOCK):
            rows, wide = np.arange(start, min(start + BLOCK, len(q))), min(beam, len(self.x))
            while len(rows):
                again = []
                step = max(16, 4 * BLOCK * BEAM // max(wide, 4 * BEAM))
                for some in (rows[i:i + step] for i in range(0, len(rows), step)):
                    if wide < len(self.x):
                        ids, sims = self.search(q[some], wide)
                    else:
                        sims = q[some] @ self.x.T
                        ids = np.broadcast_to(np.arange(len(self.x)), sims.shape)
                    near = (sims >= least) & (ids >= 0)
                    for row, found, close in zip(some.tolist(), ids, near):
                        if 2 * close.sum() > wide and wide < len(self.x):
                            again.append(row)
                        else:
                            yield row, found[close]
                rows, wide = np.array(again, np.int64), min(4 * wide, len(self.x))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matches(graph: Graph, x: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Which vectors of ``x`` are linked with which of ``q``: verified in double precision.

    The graph is audited with some rows of ``q`` against all of ``x``; beams are widened
    until the audit passes or a beam holds the whole shard, which finds everything.  Rows are
    added to the audit until it has seen ``EVIDENCE`` links or all rows, so it never passes for
    want of links; what an audit has computed is found.
    """
    order = np.argsort(np.arange(len(q)) * 0.6180339887498949 % 1, kind="stable")  # evenly spread at any length
    seen, true = 0, []
    for start in range(0, len(q), AUDIT):
        part = q[order[start:start + AUDIT]] @ x.T >= least
        true.append(part)
        seen += int(part.sum())
        if seen >= EVIDENCE:
            break
    true = np.concatenate([np.zeros((0, len(x)), bool), *true])
    audit = order[:len(true)]
    if len(audit) == len(q):
        hits = np.zeros((len(q), len(x)), bool)
        hits[audit] = true
        return hits
    hits, beam = np.zeros((len(q), len(x)), bool), BEAM
    low = q.astype(np.float32)
    while True:
        if beam >= len(x):
            for i in range(0, len(q), BLOCK):
                hits[i:i + BLOCK] = q[i:i + BLOCK] @ x.T >= least
            return hits
        for row, ids in graph.within(low, least - 1e-4, beam):
            hits[row, ids] = x[ids] @ q[row] >= least
        if (hits[audit] & true).sum() >= RECALL * true.sum():
            hits[audit] |= true
            return hits
        beam *= 4


def spanning(hits: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric ``hits`` join: one tree for each group."""
    out, left = [], hits.any(axis=1)
    for start in range(len(hits)):
        if not left[start]:
            continue
        left[start], ahead = False, [start]
        while ahead:
            node = ahead.pop()
            found = np.nonzero(hits[node] & left)[0]
            left[found] = False
            out += [(node, int(i)) for i in found]
            ahead += found.tolist()
    return out


def shard_graphs(vectors: DataFrame) -> DataFrame:
    """One row for each shard: ids, weights, vectors and the graph."""
    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rep", "ascending"), ("h1", "ascending")])
        x = np.array(group["embedding"].to_pylist(), np.float64)
        graph = Graph(unit(x), int(group["shard"][0].as_py()))
        layers = np.stack(graph.layers)
        row = {"label": group["label"][0], "dim": group["dim"][0], "shard": group["shard"][0], "shards": group["shards"][0],
               "reps": group["rep"].to_pylist(), "weights": group["n"].to_pylist(), "vectors": x.tobytes(),
               "layers": layers.tobytes(), "depth": len(layers), "entry": graph.entry}
        return pa.Table.from_pylist([{k: v.as_py() if isinstance(v, pa.Scalar) else v for k, v in row.items()}], schema=kinds)

    kinds = pa.schema([
        ("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int64()), ("shards", pa.int64()), ("reps", pa.list_(pa.int64())),
        ("weights", pa.list_(pa.int64())), ("vectors", pa.binary()), ("layers", pa.binary()), ("depth", pa.int32()), ("entry", pa.int32())])
    schema = ("label string, dim int, shard bigint, shards bigint, reps array<bigint>, weights array<bigint>, vectors binary, "
              "layers binary, depth int, entry int")
    return vectors.groupBy("label", "dim", "shard").applyInArrow(build, schema)


def linked(shards: DataFrame, least: float) -> DataFrame:
    """Search each pair of shards of a label both ways: rows (rep, links) and forest edges
    (rep, other).

    Each side of a pair is sent to it under the numbers of both shards, so no task holds the
    pairs of a label, only one pair at a time.
    """
    def load(row: dict) -> tuple[np.ndarray, Graph]:
        x = unit(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]))
        layers = np.frombuffer(row["layers"], np.int32).reshape(row["depth"], len(x), WIDE)
        return x, Graph(x, 0, list(layers), row["entry"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "links", "other")})
        a, b = left.to_pylist()[0], right.to_pylist()[0]
        (x, graph_x), (y, graph_y) = load(a), load(b)
        hits = matches(graph_y, y, x, least)
        if a["shard"] == b["shard"]:
            np.fill_diagonal(hits, False)
            hits |= hits.T
            edges = [(a["reps"][i], a["reps"][j]) for i, j in spanning(hits)]
            sums = [(a, hits @ np.array(a["weights"]))]
        else:
            hits |= matches(graph_x, x, y, least).T
            n = len(x)
            rows, columns = np.nonzero(hits.any(axis=1))[0], np.nonzero(hits.any(axis=0))[0]
            whole = np.zeros((len(rows) + len(columns),) * 2, bool)
            whole[:len(rows), len(rows):] = hits[np.ix_(rows, columns)]
            whole |= whole.T
            names = [a["reps"][i] for i in rows] + [b["reps"][i] for i in columns]
            edges = [(names[i], names[j]) for i, j in spanning(whole)]
            sums = [(a, hits @ np.array(b["weights"])), (b, hits.T @ np.array(a["weights"]))]
        counts = [(rep, int(c), None) for side, found in sums for rep, c in zip(side["reps"], found) if c]
        counts += [(i, 0, j) for i, j in edges]
        columns_out = list(zip(*counts)) if counts else [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("rep", "links", "other"), columns_out)})

    keys = ("label", "dim", "first", "second")
    left = shards.withColumn("first", F.col("shard")).withColumn("second", F.explode(F.sequence("shard", F.col("shards") - 1)))
    right = shards.withColumn("second", F.col("shard")).withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), "shard")))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "rep bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of (vec_id, embedding, label).

    Vectors of one label are linked if their cosine, in double precision, is at least
    ``least``; ``n_links`` counts the other rows linked directly, ``component_id`` is the
    least id reachable, and ``kept`` marks the row whose id that is.  Copies are indexed once
    and counted as often as they occur.

    Null, zero and empty vectors, vectors with null or non-finite components, rows with a
    null label or a null id link with nothing: no links, their own id as component.  Vectors
    of different lengths do not link.  Ids name vectors: two different vectors with one id
    share links and component.  Other columns are not read.
    """
    store = Store(vectors.sparkSession, "hnsw")
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = store.put(vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        v.cast("array<double>").alias("embedding")).withColumn("good", good).withColumn(
        "h1", F.when(F.col("good"), F.xxhash64("label", v))).withColumn("h2", F.when(F.col("good"), F.xxhash64(v, "label"))))
    distinct = store.put(rows.where("good").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"),
        F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")))
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / PER_SHARD).alias("shards"), F.count(F.lit(1)).alias("n"))
    placed = even_join(distinct.drop("h2"), sizes.drop("n"), ["label", "dim"], hot_keys(sizes, ["label", "dim"], "n"))
    # Each shard knows how many there are of its label.
    shards = store.put(shard_graphs(placed.withColumn("shard", F.pmod("h1", "shards"))))
    found = store.put(linked(shards, least))
    links = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), store)
    named = distinct.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = even_join(rows.select("vec_id", "h1", "h2"), store.put(named), ["h1", "h2"], hot_keys(distinct, ["h1", "h2"], "n"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
