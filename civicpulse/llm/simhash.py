"""SimHash near-duplicates: fingerprints that differ in few bits, found by shared blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, even_join, hot_keys, texts
from .components import components

SEED = 42
#: Width of a block; all but ``distance`` of the 64 / BLOCK blocks must be equal.
BLOCK = 8


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the ``shingle``-word shingles of a lower-cased text, as a signed long.

    A bit is set if it is set in over half of the shingles' XXH64.  Fewer words than a
    shingle are one shingle; no words give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - size + 1]
    slices = zip(starts.tolist(), ends[size - 1:].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in slices), np.uint64, count=len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``fp`` (long); one row out per row in, null texts count as empty."""
    schema = T.StructType([docs.schema[id_column], T.StructField("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text, shingle) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def block_masks(distance: int) -> list[int]:
    """For each choice of ``distance`` blocks that may differ, the mask of all other bits."""
    full, blocks = (1 << 64) - 1, range(64 // BLOCK)
    masks = (full & ~sum(((1 << BLOCK) - 1) << BLOCK * b for b in free) for free in combinations(blocks, distance))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that join all values within ``distance`` bits: a spanning forest.

    Values are looked up with all flips of the free bits if that is less work than
    comparing all; either way every pair of near values ends in one tree.
    """
    n, parent = len(values), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    free = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [b for b in range(64) if free >> b & 1]
    flips = [sum(1 << b for b in some) for k in range(1, distance + 1) for some in combinations(bits, k)]
    if len(flips) < n:
        order = np.argsort(values)
        ranked = values[order]
        for flip in flips:
            wanted = values ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(ranked, wanted), n - 1)
            for i in np.nonzero(ranked[at] == wanted)[0].tolist():
                link(i, int(order[at[i]]))
    else:
        for i in range(n - 1):
            for j in (np.nonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance)[0] + i + 1).tolist():
                link(i, j)
    return out


def near_edges(prints: DataFrame, distance: int) -> DataFrame:
    """Edges ``a, b`` between the ``rep`` of near ``fp``; ``prints`` has each fp once.

    Two fingerprints within ``distance`` bits agree on all blocks but ``distance``.  They
    meet under that choice's key, where at most ``distance * BLOCK`` bits are free: with two
    free blocks a group has 2^16 members at most, whatever the input, and sends a spanning
    forest instead of its pairs.
    """
    if not 0 < distance <= 2:
        raise ValueError("distance must be 1 or 2, so that the blocks bound the groups")
    masks = F.array(*[F.lit(m) for m in block_masks(distance)])
    keyed = prints.select("fp", "rep", F.posexplode(masks).alias("choice", "mask"))
    groups = keyed.groupBy("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("block")).agg(
        F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps")).where(F.size("fps") > 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps, reps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, j in forest(np.array(fps, np.int64).view(np.uint64), distance):
                    a.append(reps[i])
                    b.append(reps[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("fps", "reps").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, fp, component_id`` per document.

    ``component_id`` is the least id reachable over fingerprints that differ in at most
    ``distance`` bits.  Null and empty texts have fingerprint zero and are linked like any
    other; copies share a fingerprint.  A row without id keeps its row and helps no one: its
    component is the least id of its own group, null if there is none.  Other columns are
    not read.
    """
    store = Store(docs.sparkSession, "simhash")
    rows = store.put(fingerprints(
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")), shingle))
    counts = store.put(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    named = counts.where("rep IS NOT NULL")
    groups = components(near_edges(named, distance), store)
    found = named.join(groups, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return even_join(rows, store.put(found), ["fp"], hot_keys(counts, ["fp"], "n"), "left")
