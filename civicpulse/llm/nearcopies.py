"""Near copies by the Jaccard similarity of word shingles: SimHash and bands of minima, then whole sets.

Texts whose SimHash fingerprints are equal or near are compared first.  Of sets of a similarity of
0.8 hardly any are within its two bits, so bands of minima find the others.  A set's minima under many orders agree with another's as often as the sets are similar.
Sets meet where a band of minima agrees: sets of a similarity of 0.8 are missed with a chance
below one in a million, sets that share a passage alone hardly ever meet.  What meets is
compared in whole with one leader of a band's group.  What is still apart then meets where its
differences from another leader do, which is seldom for sets that are not similar.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hashes, Store, even_join, hot_keys, mix, row_key, sequence_hashes, texts
from .components import components
from .simhash import fingerprint, near_edges

#: Bands and the minima in each: 1 - (1 - 0.8 ** 5) ** 40 of the pairs at 0.8 meet.
BANDS, ROWS = 40, 5
#: Words in a shingle of the fingerprints, and the bits by which near ones differ at most.
PRINT_WORDS, PRINT_BITS = 3, 2
#: Shingles whose minima are taken at a time.
STEP = 4096


def shingles(text: bytes, size: int, known: Hashes) -> np.ndarray:
    """The set of hashes of the ``size``-word shingles, sorted; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(sequence_hashes(known.of(words), min(size, len(words)), 0x9E3779B97F4A7C15))


def orders() -> tuple[np.ndarray, np.ndarray]:
    """One mask and one odd factor for each order."""
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2, None], seeds[1::2, None] | np.uint64(1)


def bands(x: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key for each band of a set: a hash of its minima and of the band's number."""
    if not len(x):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(x), STEP):
            least = np.minimum(least, ((x[at:at + STEP] ^ masks) * factors).min(axis=1))
        key = np.arange(BANDS, dtype=np.uint64)
        for part in least.reshape(BANDS, ROWS).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row its key, the hash of its set (``node``), the set's ``size``, its bands and the text's fingerprint."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("k1", "k2", "node")],
        T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("fp", T.LongType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        known, (masks, factors) = Hashes(22), orders()
        for batch in batches:
            words = texts(batch.column(3))
            sets = [shingles(text, shingle, known) for text in words]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 5) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(nodes.view(np.int64)), pa.array([len(x) for x in sets], pa.int32()),
                 pa.array([bands(x, masks, factors) for x in sets], pa.list_(pa.int64())),
                 pa.array([fingerprint(text, PRINT_WORDS) for text in words], pa.int64())], names=schema.names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(), "text").mapInArrow(work, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` of the rows ``wanted`` (node, k1, k2), one row for each node."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(22)
        for batch in batches:
            sets = [shingles(text, shingle, known) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    # Wanted rows grow with the documents, so this is a shuffle at every size.  Rows equal in
    # id and text answer to one wanted row; one of them is enough.
    rows = docs.select(*row_key(), "text").join(wanted.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return rows.select("node", "text").mapInArrow(work, "node bigint, hashes array<bigint>")


def facing(pairs: DataFrame, sets: DataFrame, store: Store) -> DataFrame:
    """``a, b, set_a, set_b`` of the stored ``pairs`` (a, b).

    The set of ``b`` travels once for each pair; the sets of frequent ``a`` are broadcast.
    """
    counts = store.put(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    members = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")).hint("merge"), "b")
    leaders = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")).join(counts.select("a").hint("merge"), "a")
    hot = counts.where(F.col("n") >= F.lit(max(100, (counts.agg(F.sum("n")).first()[0] or 0) // 1000))).select("a")
    return even_join(members, leaders, ["a"], hot).select("a", "b", "set_a", "set_b")


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``least`` or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def similar(pairs: DataFrame, sets: DataFrame, least: float, store: Store) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets have a Jaccard similarity of ``least`` or more."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.asarray(x.values), np.asarray(y.values), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = store.put(pairs)
    out = store.put(facing(pairs, sets, store).mapInArrow(work, "a bigint, b bigint"))
    store.drop(pairs)
    return out


def differences(pairs: DataFrame, sets: DataFrame, least: float, store: Store) -> DataFrame:
    """For each of the ``pairs`` (a, b) the ``size`` of b's set, whether the two are ``linked`` by
    their similarity, and ``apart``: the shingles that one of them holds alone."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(np.asarray(x.values), np.asarray(y.values)) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(y) for _, y in both], pa.int32()),
                 pa.array([bool(alike(x, y, least)) for x, y in both], pa.bool_()),
                 pa.array([np.setxor1d(x, y, assume_unique=True) for x, y in both], pa.list_(pa.int64()))],
                names=["a", "b", "size", "linked", "apart"])

    pairs = store.put(pairs)
    out = store.put(facing(pairs, sets, store).mapInArrow(work, "a bigint, b bigint, size int, linked boolean, apart array<bigint>"))
    store.drop(pairs)
    return out


def fitting(a: Column, b: Column, least: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def close_prints(nodes: DataFrame, store: Store) -> DataFrame:
    """Pairs ``a, b`` of nodes by SimHash: of equal fingerprints, each with the least node of its
    fingerprint; of near ones, the pairs that join them."""
    prints = store.put(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")))
    several = prints.where("n > 1")
    equal = even_join(nodes.select("node", "fp"), several, ["fp"], hot_keys(several, ["fp"], "n")).where("node <> rep")
    pairs = equal.select("rep", "node").union(near_edges(prints, PRINT_BITS).select("a", "b"))
    out = store.put(pairs.select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b")).distinct())
    store.drop(prints)
    return out


def narrowed(open_: DataFrame, sets: DataFrame, least: float, store: Store) -> DataFrame:
    """The rows of ``open_`` (key, node, component) that some other can be similar enough to, with
    the share ``own`` of their shingles that no other open set has.

    A shingle of one set alone is in no intersection.  A set in which too few are shared is
    similar to none, so it needs no comparison.
    """
    nodes = open_.select("node").distinct()
    each = sets.join(nodes.hint("merge"), "node").select("node", F.explode("hashes").alias("hash"))
    alone = each.groupBy("hash").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    known = store.put(sets.select("node", F.size("hashes").alias("size")).join(nodes.hint("merge"), "node").join(
        own.hint("merge"), "node", "left").select("node", (F.coalesce("own", F.lit(0)) / F.col("size")).alias("own")).where(
        F.col("own") <= 1 - least + 1e-6))
    out = store.put(open_.join(known.hint("merge"), "node"))
    store.drop(known)
    return out


def crossing(stars: DataFrame, least: float, store: Store) -> DataFrame:
    """Pairs ``a, b`` that can be similar, of members ``b`` of one star (center ``a``) in different
    components; ``stars`` has a, b, size, component and what is ``apart`` of b's set and a's.

    Sets x and y are similar if they differ in ``h = (1 - least) / (1 + least) * (|x| + |y|)``
    shingles or fewer.  What they differ in is what their differences from the center differ in.
    Of two that are not both similar to the center, the differences are more than ``h`` in all, so
    similar ones have some in common.  In x's differences, the rarest in the star first, those
    ahead of the first common one are in x's alone: ``(h + |x's| - |y's|) / 2`` at most, and x's
    own ones, which no other member has, are among these.  So members meet by their first few
    differences; the more of them are their own, the fewer.
    """
    split = store.put(stars.groupBy("a").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high"))
    open_ = store.put(even_join(stars, split, ["a"], hot_keys(split, ["a"], "n")).select("a", "b", "size", "component", "apart"))
    each = open_.select("a", "b", F.explode("apart").alias("hash"))
    held = store.put(each.groupBy("a", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = even_join(each, held, ["a", "hash"], hot_keys(held, ["a", "hash"], "n")).groupBy("a", "b").agg(
        F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("shared"))
    # Two sizes that fit: the larger is at most 1 / least of the smaller.
    ratio = (1 - least) / (1 + least)
    most = ratio * (1 + 1 / least) * F.col("size") + 1e-3
    ranked = open_.select("a", "b", "size", "component", F.size("apart").alias("n")).join(shared.hint("merge"), ["a", "b"]).withColumn(
        "own", F.col("n") - F.size("shared"))
    first = F.slice("shared", 1, F.greatest(F.floor(most - F.col("own")).cast("int") + 1, F.lit(0)))
    posts = store.put(ranked.select("a", "b", "size", "component", "n", "own", F.posexplode(first).alias("rank", "held")).select(
        "*", F.col("held.hash").alias("hash")).drop("held"))
    # Of two, y is the one with fewer differences: it has half of h at most to itself.
    columns = [c for c in posts.columns if c not in ("a", "hash")]
    few = posts.where(F.col("rank") + F.col("own") <= most / 2).select("a", "hash", *[F.col(c).alias(f"y_{c}") for c in columns])
    x, y = F.col, lambda c: F.col(f"y_{c}")
    h, more = ratio * (x("size") + y("size")) + 1e-6, x("n") - y("n")
    met = posts.join(few, [posts["a"] == few["a"], posts["hash"] == few["hash"], (
        (x("component") != y("component")) & ((more > 0) | ((more == 0) & (x("b") > y("b")))) & fitting(x("size"), y("size"), least)
        & (2 * (x("rank") + x("own")) <= h + more) & (2 * (y("rank") + y("own")) <= h - more))])
    out = store.put(met.select(F.least("b", "y_b").alias("a"), F.greatest("b", "y_b").alias("b")).distinct())
    store.drop(split, open_, held, posts)
    return out


def links(docs: DataFrame, nodes: DataFrame, shingle: int, least: float, store: Store) -> DataFrame:
    """``node, component`` of the nodes that some similar node is joined with.

    First each node is compared with those that SimHash finds and with the least node that its
    bands meet, which joins most of a large group of near copies.  Of the groups of one band
    whose members are still in different components, those members leave that hold too many
    shingles of their own; the others are compared with the one of them that has the fewest,
    which among copies of one text with different edits is near to all of them.  In that star,
    what is still in different components is compared where differences from its center meet.
    So no pair is left out, groups are never held whole, and their pairs are not enumerated.
    """
    near = close_prints(nodes, store)
    each = nodes.select("node", "size", F.explode("bands").alias("key"))
    counts = store.put(each.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = store.put(even_join(each, counts, ["key"], hot_keys(counts, ["key"], "n")).select("key", "node", "size", "lead"))
    store.drop(counts)
    meeting = met.select("node").union(near.select("a")).union(near.select("b")).distinct()
    wanted = meeting.join(nodes.select("node", "least.k1", "least.k2").hint("merge"), "node")
    sets = store.put(whole_sets(docs, wanted, shingle))
    first = met.where(F.col("node") != F.col("lead.node")).where(fitting(F.col("size"), F.col("lead.size"), least))
    first = first.groupBy("node").agg(F.min("lead.node").alias("a")).select("a", F.col("node").alias("b"))
    edges = similar(near.unionByName(first).distinct(), sets, least, store)
    groups = store.put(components(edges, store))
    placed = store.put(met.join(groups.hint("merge"), "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")))
    store.drop(near, met)
    reach = [F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")]
    split = store.put(placed.groupBy("key").agg(*reach).where("low < high"))
    open_ = store.put(even_join(placed, split, ["key"], hot_keys(split, ["key"], "n")).select("key", "node", "component"))
    active = narrowed(open_, sets, least, store)
    centers = store.put(active.groupBy("key").agg(*reach, F.min(F.struct("own", "node")).alias("lead")).where("low < high"))
    facing_center = even_join(active, centers, ["key"], hot_keys(centers, ["key"], "n")).where(F.col("node") != F.col("lead.node"))
    pairs = facing_center.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = differences(pairs, sets, least, store)
    store.drop(placed, split, open_, active, centers)
    if stars.limit(1).count():
        edges = edges.unionByName(stars.where("linked").select("a", "b"))
        groups = store.put(components(edges, store))
        rest = crossing(stars.join(groups.withColumnRenamed("node", "b").hint("merge"), "b", "left").select(
            "a", "b", "size", "apart", F.coalesce("component", "b").alias("component")), least, store)
        if rest.limit(1).count():
            groups = store.put(components(edges.unionByName(similar(rest, sets, least, store)), store))
    store.drop(stars, sets)
    return groups


def representatives(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, whole rows, one for each group of near copies.

    Documents are linked if the sets of their ``shingle``-word shingles (ASCII lower case) have
    a Jaccard similarity of ``least`` or more; groups are what links join.  Texts without
    words, null ones too, are copies of each other.  Of each group one row stays: the least
    doc_id (nulls last), for one doc_id the least row hash, of equal ids and texts the row that
    is least as JSON.  Columns of any name and type are passed on; an empty table stays empty.
    """
    store = Store(docs.sparkSession, "nearcopies")
    rows = store.put(described(docs.select("doc_id", "text"), shingle))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    nodes = store.put(rows.groupBy("node").agg(
        F.min(order).alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    repeated = store.put(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    store.drop(rows)
    groups = links(docs.select("doc_id", "text"), nodes, shingle, least, store)
    stay = nodes.join(groups.hint("merge"), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(
        F.min("least").alias("least")).select("least.k1", "least.k2")
    stay = store.put(stay.join(repeated.hint("merge"), ["k1", "k2"], "left"))
    store.drop(nodes, repeated)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select(F.struct(*columns).alias("row"), *row_key()).join(stay.hint("merge"), ["k1", "k2"])
    alone = joined.where("n IS NULL").select("row.*")
    once = joined.where("n > 1").groupBy("k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.unionByName(once.select("row.*"))
