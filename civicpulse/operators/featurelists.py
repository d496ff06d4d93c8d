"""Features of many texts as packed lists.

A text travels as its tokens in one string.  In a task the words of some megabytes of text
are numbered in their order, and a feature is one number: that of its word, or of its two
words together.  A list holds features in order, as its own words and numbers, compressed.
It belongs to one part of all features, dealt by a hash of the longer word, so lists of
different tasks meet in one group, and one row moves what else were thousands.  Rare words
are long and many: so most words are needed by the lists of one part only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import floor, log
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import PAIR_SEPARATOR

NANO = 1_000_000_000
# Bytes of tokens whose features are numbered together, and cells that are added up at once.
PIECE_BYTES, CELLS = 8 * 1024 * 1024, 4_000_000
PACKED = "feature_part int, packed binary"
DEALT = "block bigint, packed binary"
ASKED = ANSWERED = "feature_part int, block bigint, packed binary"


class Names(NamedTuple):
    """Features: the number of a word, or, from ``len(words)`` on, those of two words in one."""

    words: pa.Array
    ids: np.ndarray

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word, and the second or -1."""
        n = max(1, len(self.words))
        pair = self.ids >= len(self.words)
        return np.where(pair, self.ids // n - 1, self.ids), np.where(pair, self.ids % n, -1)

    def among(self, words: pa.Array) -> Names:
        """The same features by the numbers of other words; -1 if a word is not there."""
        at = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy().astype(np.int64)
        first, second = self.halves()
        there = (at[first] >= 0) & ((second < 0) | (at[second] >= 0))
        return Names(words, np.where(there, np.where(second < 0, at[first], ids_of(at[first], at[second], len(words))), -1))

    def texts(self) -> pa.Array:
        first, second = self.halves()
        both = pc.binary_join_element_wise(
            self.words.take(pa.array(first)), self.words.take(pa.array(np.maximum(second, 0))), PAIR_SEPARATOR)
        return pc.if_else(pa.array(second < 0), self.words.take(pa.array(first)), both)


class Features(NamedTuple):
    """Distinct features of texts: ``rows`` and ``numbers`` say which text has which of
    ``names``; the names of a part lie together, in order, and ``parts`` says where they start."""

    rows: np.ndarray
    numbers: np.ndarray
    names: Names
    parts: list[tuple[int, int, int]]


def ids_of(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    return (first + 1) * n + second


def joined(chunks: Iterable[pa.Array], kind: pa.DataType) -> pa.Array:
    chunks = [c.cast(kind) for c in chunks]
    return pa.concat_arrays(chunks) if chunks else pa.array([], kind)


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return joined(column.chunks, column.type) if isinstance(column, pa.ChunkedArray) else column


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the distinct values in order."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, and the distinct values, both in order."""
    at, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[at], found[order]


def total(places: np.ndarray, amounts: np.ndarray, n: int) -> np.ndarray:
    sums = np.zeros(n, np.int64)
    np.add.at(sums, places, amounts)
    return sums


def parts_of(names: Names, parts: int) -> np.ndarray:
    """The part of each feature: that of its longer word, of the later one of two that are as long."""
    hashed, n = np.array([crc32(w.encode()) for w in names.words.to_pylist()], np.int64) % parts, len(names.words)
    size = pc.binary_length(names.words).to_numpy().astype(np.int64) * n + np.arange(n)
    first, second = names.halves()
    return hashed[np.where((second >= 0) & (size[second] > size[first]), second, first)]


def by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order in which parts lie together, and each part with its start and end there."""
    order = np.argsort(part, kind="stable")
    held, starts = np.unique(part[order], return_index=True)
    return order, list(zip(held.tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]))


def features_in(texts: pa.Array, parts: int) -> Features:
    """The single tokens and neighbour pairs of each text, as ``features_of`` has them."""
    lists = pc.split_pattern(texts.cast(pa.string()), PAIR_SEPARATOR)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    codes, words = numbered(lists.flatten())
    n, text = len(words), np.repeat(np.arange(len(sizes)), sizes)
    near = text[1:] == text[:-1]
    place, ids = distinct(np.concatenate([codes, ids_of(codes[:-1], codes[1:], n)[near]]))
    if not len(ids):
        return Features(ids, ids, Names(words, ids), [])
    rows, numbers = np.divmod(pd.unique(np.concatenate([text, text[1:][near]]) * len(ids) + place), len(ids))
    # The features are in order already.
    order, places = by_part(parts_of(Names(words, ids), parts))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return Features(rows, rank[numbers], Names(words, ids[order]), places)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of stretches, one after the other."""
    return np.repeat(starts - starts_of(sizes), sizes) + np.arange(sizes.sum())


def pieces(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """Rows together up to ``PIECE_BYTES`` of text; more only where one row has more."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ends):
            done = ends[start - 1] if start else 0
            stop = max(start + (not held), int(np.searchsorted(ends, done + PIECE_BYTES - size, "right")))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size, start = size + int(ends[stop - 1] - done), stop
            if start < len(ends):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


# ---- packing ----------------------------------------------------------------------

def pack(**columns: pa.Array | np.ndarray) -> bytes:
    """Arrays of any lengths, numbers from zero on in as few bytes as the greatest takes."""
    out = {}
    for name, values in columns.items():
        if not isinstance(values, pa.Array):
            small = values.astype(np.min_scalar_type(int(values.max()))) if len(values) and values.min() >= 0 else values
            values = pa.array(small)
        out[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    table = pa.table(out)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def pack_names(names: Names) -> dict[str, pa.Array | np.ndarray]:
    """Features with the words that they need."""
    first, second = names.halves()
    at, needed = distinct(np.concatenate([first, np.where(second < 0, first, second)]))
    words = names.words.take(pa.array(needed))
    first, after = at[:len(first)], at[len(first):]
    _, ends, data = words.buffers()
    start, end = np.frombuffer(ends, np.int32)[[words.offset, words.offset + len(words)]] if len(words) else (0, 0)
    return {"bytes": np.frombuffer(data or b"", np.uint8)[start:end], "lengths": pc.binary_length(words).to_numpy(),
            "first": first, "second": np.where(second < 0, 0, after + 1)}


def unpack(packed: pa.Scalar) -> dict[str, pa.Array]:
    table = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
    return {name: table[name].chunk(0).flatten() for name in table.column_names}


def whole_numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def names_in(held: dict[str, pa.Array]) -> Names:
    lengths = whole_numbers(held["lengths"])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(
        len(lengths), pa.py_buffer(offsets), pa.py_buffer(held["bytes"].to_numpy(zero_copy_only=False).astype(np.uint8)))
    first, second = whole_numbers(held["first"]), whole_numbers(held["second"])
    return Names(words, np.where(second == 0, first, ids_of(first, second - 1, len(words))))


def unpacked(rows: pa.Table) -> list[dict[str, pa.Array]]:
    return [unpack(x) for x in whole(rows["packed"])]


def together(lists: list[dict[str, pa.Array]], name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(whole_numbers(x[name]) for x in lists)])


def label_rows(names: pa.Array, rows: dict[str, pa.Array], *columns: str) -> dict[str, pa.Array]:
    """Columns of some labels, from rows that have them."""
    at = pc.index_in(names, value_set=rows["label"])
    return {"label": names, **{c: rows[c].cast(pa.int64()).take(at) for c in columns}}


# ---- training ---------------------------------------------------------------------

def counted(parts: int):
    """Rows with ``words`` and a label to lists of counted pairs, one for each part."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "words"):
            found = features_in(whole(piece["words"]), parts)
            label, kinds = numbered(whole(piece["label"]).cast(pa.string()))
            labels = label_rows(kinds, {c: whole(piece[c]) for c in LABEL}, *LABEL[1:])
            cells, n = np.unique(found.numbers * len(kinds) + label[found.rows], return_counts=True)
            feature, label = np.divmod(cells, max(1, len(kinds)))
            sizes = np.bincount(feature, minlength=len(found.names.ids))
            ends = np.cumsum(sizes)
            for part, a, b in found.parts:
                i, j = ends[a] - sizes[a], ends[b - 1]
                at, held = distinct(label[i:j])
                kept = {c: v.take(pa.array(held)) for c, v in labels.items()}
                yield pa.RecordBatch.from_pydict({"feature_part": pa.array([part], pa.int32()), "packed": [pack(
                    **pack_names(Names(found.names.words, found.names.ids[a:b])), size=sizes[a:b], at=at, n=n[i:j], **kept)]})

    return work


LABEL = ("label", "docs", "prior", "absent")


def nano(p: np.ndarray) -> np.ndarray:
    at, values = distinct(p)
    # Half goes away from zero; the logarithms are negative or zero.
    return np.array([-floor(0.5 - log(x) * NANO) for x in values.tolist()], np.int64)[at]


def merged(documents: int):
    """The lists of one part to one, whose pairs have their gains; ``documents`` are all of the corpus."""

    def work(rows: pa.Table) -> pa.Table:
        lists = unpacked(rows)
        names = [names_in(x) for x in lists]
        words = numbered(joined((x.words for x in names), pa.string()))[1]
        at, ids = distinct(np.concatenate([x.among(words).ids for x in names]))
        every, kinds = numbered(joined((x["label"] for x in lists), pa.string()))
        labels = label_rows(kinds, {c: joined((x[c] for x in lists), pa.string() if c == "label" else pa.int64()) for c in LABEL}, *LABEL[1:])
        offsets = starts_of(np.array([len(x["label"]) for x in lists], np.int64))
        label = every[together(lists, "at") + np.repeat(offsets, np.array([len(x["at"]) for x in lists], np.int64))]
        place, cells = distinct(np.repeat(at, together(lists, "size")) * len(kinds) + label)
        n = total(place, together(lists, "n"), len(cells))
        feature, label = np.divmod(cells, len(kinds))
        # A feature of every document has one bin.
        bins = np.where(total(feature, n, len(ids)) == documents, 1, 2)[feature]
        # The cells of a label with one count and as many bins have one gain: such kinds are numbered.
        cell, held = distinct((label * (n.max() + 1) + n) * 2 + bins - 1)
        label, n, bins = held // 2 // (n.max() + 1), held // 2 % (n.max() + 1), held % 2 + 1
        gain = nano((n + 0.5) / (labels["docs"].to_numpy()[label] + 0.5 * bins)) - labels["absent"].to_numpy()[label]
        return pa.table({"feature_part": whole(rows["feature_part"]).slice(0, 1), "packed": [pack(
            **pack_names(Names(words, ids)), size=np.bincount(feature, minlength=len(ids)), cell=cell, at=label, n=n, gain=gain,
            label=labels["label"], prior=labels["prior"], absent=labels["absent"])]})

    return work


def pairs_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists to rows ``feature, label, n, gain``, and one without a label for each feature."""
    for batch in batches:
        for held in unpacked(pa.Table.from_batches([batch])):
            features, size, cell = names_in(held).texts(), whole_numbers(held["size"]), whole_numbers(held["cell"])
            feature, n = np.repeat(np.arange(len(size)), size), whole_numbers(held["n"])[cell]
            yield pa.RecordBatch.from_pydict({
                "feature": features.take(pa.array(feature)), "label": held["label"].take(pa.array(whole_numbers(held["at"])[cell])),
                "n": n, "gain": whole_numbers(held["gain"])[cell]})
            yield pa.RecordBatch.from_pydict({
                "feature": features, "label": pa.nulls(len(size), pa.string()), "n": total(feature, n, len(size)),
                "gain": np.zeros(len(size), np.int64)})


# ---- scoring ----------------------------------------------------------------------

def dealt(key: str):
    """Texts packed by their blocks."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "words"):
            block = piece["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            keys, words = (whole(piece[c]).take(pa.array(order)) for c in (key, "words"))
            held, starts = np.unique(block[order], return_index=True)
            for b, i, j in zip(held.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([b], pa.int64()), "packed": [pack(key=keys.slice(i, j - i), words=words.slice(i, j - i))]})

    return work


def asked(parts: int):
    """The features of a block of texts, one list for each part."""

    def work(texts: pa.Table) -> pa.Table:
        found = features_in(joined((x["words"] for x in unpacked(texts)), pa.string()), parts)
        block = whole(texts["block"])[0].as_py()
        return pa.table({
            "feature_part": pa.array([p for p, _, _ in found.parts], pa.int32()),
            "block": pa.array([block] * len(found.parts), pa.int64()),
            "packed": pa.array([pack(**pack_names(Names(found.names.words, found.names.ids[a:b]))) for _, a, b in found.parts], pa.binary())})

    return work


def answered(model: pa.Table, requests: pa.Table) -> pa.Table:
    """What the labels gain by the features that each block asks for: the numbers of cells, in the
    order of its list, none for an unknown feature, and the cells."""
    out = {"feature_part": [], "block": [], "packed": []}
    for held in unpacked(model):
        names, sizes, cell = names_in(held), whole_numbers(held["size"]), whole_numbers(held["cell"])
        label, gain, starts = whole_numbers(held["at"]), whole_numbers(held["gain"]), starts_of(sizes)
        for part, block, packed in zip(requests["feature_part"].to_pylist(), requests["block"].to_pylist(), whole(requests["packed"])):
            ids = names_in(unpack(packed)).among(names.words).ids
            # Both are in order, but for what is not there.
            at = np.minimum(np.searchsorted(names.ids, ids), len(names.ids) - 1)
            known = np.flatnonzero(names.ids[at] == ids)
            size = np.zeros(len(ids), np.int64)
            size[known] = sizes[at[known]]
            cells, kinds = distinct(cell[spans(starts[at[known]], size[known])])
            numbers, kept = distinct(label[kinds])
            out["feature_part"].append(part)
            out["block"].append(block)
            out["packed"].append(pack(size=size, cell=cells, at=numbers, gain=gain[kinds], **{
                c: held[c].take(pa.array(kept)) for c in ("label", "prior", "absent")}))
    return pa.table({"feature_part": pa.array(out["feature_part"], pa.int32()), "block": pa.array(out["block"], pa.int64()),
                     "packed": pa.array(out["packed"], pa.binary())})


def added(places: np.ndarray, gains: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, in order, and the exact sums of their gains, which are positive."""
    if span <= 2 * CELLS:
        sums = total(places, gains, span)
        held = np.flatnonzero(sums)
        return held, sums[held]
    at, held = distinct(places)
    return held, total(at, gains, len(held))


def scored(key: str, parts: int):
    """The texts of a block with the answers to it: for each key its number of known features, and
    the best of the labels that gain something, with its score."""

    def work(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unpacked(texts)
        keys = pa.concat_arrays([x["key"] for x in rows]).dictionary_encode(null_encoding="encode")
        owner = keys.indices.to_numpy().astype(np.int64)
        many = len(keys.dictionary)
        found = features_in(joined((x["words"] for x in rows), pa.string()), parts)
        lists = dict(zip(answers["feature_part"].to_pylist(), unpacked(answers)))
        held = [lists[p] for p, _, _ in found.parts if p in lists]
        every, kinds = numbered(joined((x["label"] for x in held), pa.string()))
        labels = label_rows(kinds, {c: joined((x[c] for x in held), pa.string() if c == "label" else pa.int64()) for c in (
            "label", "prior", "absent")}, "prior", "absent")
        prior, absent, count = labels["prior"].to_numpy(), labels["absent"].to_numpy(), len(kinds)
        # Kinds of cells and cells of all lists, one after the other.
        size = np.zeros(len(found.names.ids), np.int64)
        for part, a, b in found.parts:
            if part in lists:
                if len(lists[part]["size"]) != b - a:
                    raise ValueError("the texts of a block have changed between two reads")
                size[a:b] = whole_numbers(lists[part]["size"])
        lengths = lambda name: np.array([len(x[name]) for x in held], np.int64)
        label = every[together(held, "at") + np.repeat(starts_of(lengths("label")), lengths("at"))]
        gain = together(held, "gain")
        cell = together(held, "cell") + np.repeat(starts_of(lengths("at")), lengths("cell"))
        starts = starts_of(size)
        # What each key has of the known features, key by key.
        there = size[found.numbers] > 0
        owners, at = owner[found.rows[there]], found.numbers[there]
        order = np.argsort(owners, kind="stable")
        owners, at = owners[order], at[order]
        known = np.bincount(owners, minlength=many)
        best, winner = np.zeros(many, np.int64), np.full(many, -1)
        ends, weight = np.cumsum(known), np.concatenate([[0], np.cumsum(size[at])])
        first = 0
        while first < many:
            # Keys together up to a number of cells; a key alone may have more, which are added up in steps.
            i = ends[first] - known[first]
            last = max(first + 1, int(np.searchsorted(weight[ends], weight[i] + CELLS, "right")))
            j, span = ends[last - 1], (last - first) * count
            held = sums = np.zeros(0, np.int64)
            while i < j:
                k = max(i + 1, min(j, int(np.searchsorted(weight, weight[i] + CELLS, "right")) - 1))
                cells = cell[spans(starts[at[i:k]], size[at[i:k]])]
                more = added(np.repeat((owners[i:k] - first) * count, size[at[i:k]]) + label[cells], gain[cells], span)
                held, sums = added(*(np.concatenate(x) for x in zip((held, sums), more)), span) if len(held) else more
                i = k
            place, kind = np.divmod(held, max(1, count))
            score = sums + prior[kind] + known[first + place] * absent[kind]
            # Labels are numbered in order: equal scores go to the greatest.
            order = np.lexsort((kind, score, place))
            tops = order[np.flatnonzero(np.diff(place[order], append=-1))]
            best[first + place[tops]], winner[first + place[tops]] = score[tops], kind[tops]
            first = last
        none = winner < 0
        return pa.table({
            key: keys.dictionary, "known": pa.array(known, pa.int64()), "score": pa.array(best, pa.int64(), mask=none),
            "label": kinds.take(pa.array(winner, pa.int64(), mask=none))})

    return work


# ---- a model with a weight for every label ----------------------------------------

def listed(parts: int):
    """Rows ``feature, weights`` to lists, one for each part."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "feature"):
            halves = pc.split_pattern(whole(piece["feature"]).cast(pa.string()), PAIR_SEPARATOR)
            size = pc.fill_null(pc.list_value_length(halves), 0).to_numpy()
            codes, words = numbered(halves.flatten())
            # No text has a feature of more words.
            rows = np.flatnonzero((size == 1) | (size == 2))
            start, pair = starts_of(size)[rows], size[rows] == 2
            first, second = codes[start], codes[np.where(pair, start + 1, start)]
            names = Names(words, np.where(pair, ids_of(first, second, len(words)), first))
            weights = whole(piece["weights"]).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
            # Features with equal weights are of one kind.
            kind = np.zeros(len(rows), np.int64)
            for column in weights.T:
                at, found = distinct(column)
                kind = distinct(kind * len(found) + at)[0]
            order, places = by_part(parts_of(names, parts))
            for part, a, b in places:
                held = order[a:b]
                at, _ = distinct(kind[held])
                one = np.unique(at, return_index=True)[1]
                yield pa.RecordBatch.from_pydict({"feature_part": pa.array([part], pa.int32()), "packed": [pack(
                    **pack_names(Names(words, names.ids[held])), kind=at, weights=weights[held[one]].ravel())]})

    return work


def weighed(labels: int):
    """What each feature that a block asks for weighs: its kind, from one on, or 0 for an unknown one."""

    def work(model: pa.Table, requests: pa.Table) -> pa.Table:
        out = {"feature_part": [], "block": [], "packed": []}
        lists = unpacked(model)
        if lists:
            names = [names_in(x) for x in lists]
            words = numbered(joined((x.words for x in names), pa.string()))[1]
            ids = np.concatenate([x.among(words).ids for x in names])
            weights = together(lists, "weights").reshape(-1, labels)
            counts = np.array([len(x["weights"]) // labels for x in lists], np.int64)
            kind = together(lists, "kind") + np.repeat(starts_of(counts), np.array([len(x) for x in (n.ids for n in names)], np.int64))
            order = np.argsort(ids)
            ids, kind = ids[order], kind[order]
            for part, block, packed in zip(requests["feature_part"].to_pylist(), requests["block"].to_pylist(), whole(requests["packed"])):
                wanted = names_in(unpack(packed)).among(words).ids
                at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
                there = ids[at] == wanted
                numbers, kinds = distinct(kind[at[there]])
                found = np.zeros(len(wanted), np.int64)
                found[there] = numbers + 1
                out["feature_part"].append(part)
                out["block"].append(block)
                out["packed"].append(pack(kind=found, weights=weights[kinds].ravel()))
        return pa.table({"feature_part": pa.array(out["feature_part"], pa.int32()), "block": pa.array(out["block"], pa.int64()),
                         "packed": pa.array(out["packed"], pa.binary())})

    return work


def summed(key: str, parts: int, labels: int):
    """For each key of a block the exact sums of its known features' weights, ``sum_<i>``."""

    def work(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unpacked(texts)
        keys = pa.concat_arrays([x["key"] for x in rows]).dictionary_encode(null_encoding="encode")
        owner = keys.indices.to_numpy().astype(np.int64)
        found = features_in(joined((x["words"] for x in rows), pa.string()), parts)
        lists = dict(zip(answers["feature_part"].to_pylist(), unpacked(answers)))
        weights = np.zeros((len(found.names.ids), labels), np.int64)
        for part, a, b in found.parts:
            if part in lists:
                kind = whole_numbers(lists[part]["kind"])
                if len(kind) != b - a:
                    raise ValueError("the texts of a block have changed between two reads")
                weights[a:b] = np.concatenate([np.zeros((1, labels), np.int64), whole_numbers(lists[part]["weights"]).reshape(-1, labels)])[kind]
        owners, many = owner[found.rows], len(keys.dictionary)
        return pa.table({key: keys.dictionary, **{
            f"sum_{i}": pa.array(total(owners, weights[found.numbers, i], many), pa.int64()) for i in range(labels)}})

    return work
