"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick
automata, and located in all documents.

Every window of ``window`` words chooses a fingerprint among its word sequences, so windows
that are equal meet under one.  The stretches of text under fingerprints that occur more
than once are dealt to shards by fingerprint.  A shard confirms the passages whose windows
occur at least twice, compiles them into automata over words, and streams its stretches
through them.  No document needs to see another shard: what it shares with others is where its
fingerprints are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hashes, Store, even_join, hot_keys, mix, row_key, sequence_hashes, texts
from .winnow import RUN, recurring, runs

#: Words of a fingerprinted sequence.
GRAM = 8
#: A fingerprint that occurs more often is split: its windows are dealt by their own hash.
COMMON = 1000
#: Stretches of one automaton, and of one shard.
PER_AUTOMATON, PER_SHARD = 5_000, 20_000
BASE = 0x9E3779B97F4A7C15


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def word_runs(docs: DataFrame, window: int) -> DataFrame:
    """Per text its number of words, the digest of all its words, and its fingerprint runs."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType()), T.StructField("runs", T.ArrayType(RUN))])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(5)
        gram = min(GRAM, window)
        for batch in batches:
            counts, wholes, parts, sizes = [], [], [[], [], [], []], [0]
            for text in texts(batch.column(3)):
                words = text.split()
                found = runs(sequence_hashes(known.of(words), gram, BASE), window - gram + 1)
                counts.append(len(words))
                wholes.append(digest(words))
                for part, column in zip(parts, found):
                    part.append(column)
                sizes.append(sizes[-1] + len(found[0]))
            names = ["a", "first", "last", "w"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.array(np.concatenate(p) if p else [], k) for p, k in zip(parts, kinds)]
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(wholes, pa.string()), lists], names=schema.names)

    return docs.select("doc_id", *row_key(), "text").mapInArrow(work, schema)


def stretches(texts_with_hits: DataFrame, window: int) -> DataFrame:
    """The words under each recurring run, with the key that deals them to a shard.

    The key is the fingerprint; under a fingerprint that occurs more than ``COMMON`` times
    each window is a stretch of its own under its own hash, so no key holds many different
    stretches.
    """
    schema = "key bigint, k1 bigint, k2 bigint, place int, words string"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(5)
        for batch in batches:
            rows: list[tuple] = []
            for text, k1, k2, hits in zip(texts(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:])):
                words = text.split()
                own = None
                for hit in hits:
                    first, last = hit["first"], hit["last"]
                    if hit["n"] <= COMMON:
                        rows.append((hit["a"], k1, k2, first, b" ".join(words[first:last + window])))
                        continue
                    if own is None:
                        own = sequence_hashes(known.of(words), window, BASE).view(np.int64).tolist()
                    rows += [(own[i], k1, k2, i, b" ".join(words[i:i + window])) for i in range(first, last + 1)]
            for at in range(0, len(rows), 5000):
                columns = list(zip(*rows[at:at + 5000]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(columns[4], pa.binary()).cast(pa.string())],
                    names=["key", "k1", "k2", "place", "words"])

    return texts_with_hits.select("text", "k1", "k2", "hits").mapInArrow(work, schema)


def confirmed(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """``(stretch, first, last)`` of the recurring passages, in windows of the stretch.

    ``words`` are the numbers of all words, stretch after stretch.  A window is confirmed if
    its hash occurs twice or more; ``counts`` says how often each stretch does.  Neighbouring
    windows are one passage if both occur exactly as often as they occur together, so that
    none of its windows occurs anywhere without the whole passage.
    """
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    x = mix((words + 1).astype(np.uint64))
    times = []
    for length in (window, window + 1):
        at = np.nonzero(left >= length)[0]
        _, same = np.unique(sequence_hashes(x, length, BASE)[at], return_inverse=True)
        held = np.zeros(len(words), np.int64)
        if len(at):
            held[at] = np.bincount(same, counts[stretch[at]])[same]
        times.append(held)
    often, both = times
    tight = np.zeros(len(words), bool)
    tight[:-1] = (both[:-1] == often[:-1]) & (both[:-1] == often[1:])
    good = often > 1
    opens = good & ~np.concatenate(([False], (good & tight)[:-1]))
    first = np.nonzero(opens)[0]
    last = np.nonzero(good & ~tight)[0]
    base = (np.cumsum(sizes) - sizes)[stretch[first]]
    return np.stack((stretch[first], first - base, last - base), axis=1)


def located(stretch_words: list[list[bytes]], counts: list[int], window: int) -> list[int]:
    """For each stretch a mask of its windows that occur at least twice in all of them.

    The confirmed passages are compiled into an automaton over words (a word becomes one
    character), which then finds every place of every passage; one that it finds once only
    was confirmed by a hash that two windows share, and does not count.
    """
    letters: dict[bytes, int] = {}
    numbers = [[letters.setdefault(word, len(letters)) for word in words] for words in stretch_words]
    strings = ["".join([chr(i + 1 if i < 0xD7FF else i + 0x801) for i in row]) for row in numbers]
    sizes, weight = np.array([len(row) for row in numbers]), np.array(counts)
    flat = np.fromiter(chain.from_iterable(numbers), np.int64, count=int(sizes.sum()))
    found = confirmed(flat, sizes, weight, window)
    masks = [0] * len(strings)
    if not len(found):
        return masks
    passages_of, automaton = {}, ahocorasick.Automaton()
    for stretch, first, last in found.tolist():
        passage = strings[stretch][first:last + window]
        if passage not in passages_of:
            automaton.add_word(passage, (len(passages_of), len(passage)))
            passages_of[passage] = len(passages_of)
    automaton.make_automaton()
    hits = [(stretch, number, end - size + 1, size) for stretch in np.unique(found[:, 0]).tolist()
            for end, (number, size) in automaton.iter(strings[stretch])]
    times = [0] * len(passages_of)
    for stretch, number, _, _ in hits:
        times[number] += counts[stretch]
    for stretch, number, first, size in hits:
        if times[number] > 1:
            masks[stretch] |= ((1 << size - window + 1) - 1) << first
    return masks


def passages(distinct: DataFrame, window: int) -> DataFrame:
    """``key, content, mask`` of the stretches that hold a recurring window, shard by shard."""
    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys = group["key"].to_pylist()
        words = [w.split(b" ") for w in group["words"].cast(pa.binary()).to_pylist()]
        counts, masks, start = group["n"].to_pylist(), [], 0
        while start < len(keys):
            end = min(start + PER_AUTOMATON, len(keys))
            while end < len(keys) and keys[end] == keys[end - 1]:
                end += 1
            masks += located(words[start:end], counts[start:end], window)
            start = end
        out = pa.table({"key": group["key"], "content": group["content"], "n": group["n"], "mask": pa.array(masks, pa.int64())})
        return out.filter(pa.compute.not_equal(out["mask"], 0))
    return distinct.groupBy("shard").applyInArrow(work, "key bigint, content bigint, n bigint, mask bigint")


def deduplicated(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` (null if nothing was removed).

    Every word is removed that lies in a window of ``window`` words whose sequence also
    starts anywhere else, in the same document or in another.  Windows are judged on the
    input.  ``kept_sha256`` is of the kept words joined by one space.

    Null texts have no words; texts shorter than a window keep all.  Equal rows are documents
    of their own that repeat each other; null ids are allowed; other columns are not read.
    """
    if not 2 <= window or window - min(GRAM, window) < 0:
        raise ValueError("a window has at least two words")
    store = Store(docs.sparkSession, "phrases")
    rows = store.put(word_runs(docs, window))
    hits = recurring(rows, store)
    keyed = docs.select("text", *row_key())
    suspects = store.put(keyed.join(hits, ["k1", "k2"]))
    found = store.put(stretches(suspects, window).withColumn("content", F.xxhash64("words")))
    distinct = store.put(found.groupBy("key", "content", "words").agg(F.count(F.lit(1)).alias("n")))
    shards = max(1, -(-distinct.count() // PER_SHARD))
    masks = store.put(passages(distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), window))
    met = even_join(found.drop("words"), masks.drop("n"), ["key", "content"], hot_keys(masks, ["key", "content"], "n"))
    marks = met.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    schema = "k1 bigint, k2 bigint, n_removed bigint, kept string"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, places in zip(texts(batch.column(2)), batch.column(3).to_pylist()):
                words = text.split()
                starts = np.zeros(len(words) + 1, np.int64)
                for place in places:
                    mask, at = place["mask"], place["place"]
                    while mask:
                        low = mask & -mask
                        starts[at + low.bit_length() - 1] = 1
                        mask ^= low
                deltas = np.zeros(len(words) + 1, np.int64)
                at = np.nonzero(starts)[0]
                np.add.at(deltas, at, 1)
                np.add.at(deltas, at + window, -1)
                gone = np.cumsum(deltas[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.nonzero(~gone)[0]]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["k1", "k2", "n_removed", "kept"])

    # Rows that are equal were joined as one text each; once is enough here.
    once = suspects.select("k1", "k2", "text").join(marks, ["k1", "k2"]).mapInArrow(cut, schema)
    once = once.groupBy("k1", "k2").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    out = rows.drop("runs").join(once, ["k1", "k2"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("whole")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"), "kept")
