"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both token sequences tile the bytes of a text.  Every token points to the token of the
other sequence that overlaps it and reaches farthest to the right; a token that ends where
the other one ends, on the second sequence, points to itself.  Doubling all pointers at
once (pointer jumping) brings every token to the last token of its connected component, and
that token labels the group.  Many texts are worked off as one array: they share no bytes,
so no group joins them.

Counts of id pairs span all texts.  A block of texts sends each of its pairs once, with
its count; totals come back to the block, and the texts of the block look theirs up.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, texts

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Pairs of a block in one row.
CHUNK = 8192
#: Bits of a B id in an id pair.
ID_BITS = 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library.

    ``pattern`` splits texts as the file's own splitter does; with it, and if ids are in the
    order of merging, texts go through tiktoken with the same vocabulary as ranks, which gives
    the same ids in a third of the time.
    """

    def __init__(self, data: str, pattern: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.encode_special_tokens = True
        letters, model = byte_letters(), json.loads(data)["model"]
        self.bytes: list[bytes] = [b""] * self.tokenizer.get_vocab_size()
        for token, number in model["vocab"].items():
            if all(c in letters for c in token):
                self.bytes[number] = bytes(letters[c] for c in token)
        self.fast = None
        if pattern is not None:
            made = [model["vocab"][x] for x in letters]
            made += [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if sorted(made[256:]) == made[256:] and max(made[:256]) < min(made[256:], default=1 << 40):
                # Ids in the order of merging are ranks.
                ranks = {self.bytes[i]: i for i in made}
                self.fast = tiktoken.Encoding("align", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(self, batch: list[str]) -> list[Sequence[int]]:
        if self.fast:
            return [self.fast(" " + t, disallowed_special=()) for t in batch]
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in batch], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte fallback; it adds the space itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(b"" if self.model.is_control(i) else piece.replace("▁", " ").encode())

    def encode(self, batch: list[str]) -> list[Sequence[int]]:
        return self.model.encode(batch, num_threads=1)


@cache
def tokenizers_of(a: str, b: str, pattern: str | None) -> tuple[ByteLevel, Pieces]:
    """The worker's tokenizers; later tasks of the worker use them again."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteLevel(a, pattern), Pieces(base64.b64decode(b))


def jump(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every token, those of A first, the number of the terminal token of its group."""
    n = len(ends_a)
    over_a = n + np.searchsorted(ends_b, ends_a)
    over_b = np.searchsorted(ends_a, ends_b)
    own = np.arange(n, n + len(ends_b))
    over_b = np.where(ends_a[over_b] == ends_b, own, over_b) if n else own
    to = np.concatenate((over_a, over_b))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs as places in A and in B, in order."""
    starts = np.concatenate(([0], ends_a[:-1])) if len(ends_a) else ends_a
    first, last = np.searchsorted(ends_b, starts, "right"), np.searchsorted(ends_b, ends_a)
    counts = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), counts)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts - first, counts)


class Vocabulary:
    """The bytes of all tokens of a tokenizer, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        if self.size > 1 << ID_BITS:
            raise ValueError(f"a vocabulary has at most {1 << ID_BITS} tokens")
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.start[ids] - ends + lengths, lengths)
        return self.buffer[shift + np.arange(len(shift))]


class Aligner:
    """Two tokenizers with what is looked up by id."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.of_a, self.of_b = Vocabulary(a.bytes), Vocabulary(b.bytes)
        # Decimals with what follows them: a comma inside a side, or the end of the side.
        self.written = [f"{i}{end}" for size, ends in ((len(a.bytes), ",|"), (len(b.bytes), ",;")) for end in ends for i in range(size)]

    def tokens(self, batch: list[bytes]) -> tuple[list[int], list[list[np.ndarray]]]:
        """The texts that both tokenizers give back, and for each tokenizer their ids."""
        held = [i for i, text in enumerate(batch) if text]
        ids = [[np.asarray(x, np.int64) for x in side.encode([batch[i].decode("utf-8", "replace") for i in held])]
               for side in (self.a, self.b)]
        whole = np.frombuffer(b" ".join([b"", *(batch[i] for i in held)]), np.uint8)
        if all(np.array_equal(words.joined(np.concatenate(side)), whole)
               for words, side in zip((self.of_a, self.of_b), ids) if held):
            return held, ids
        good = [k for k, i in enumerate(held) if all(
            words.joined(side[k]).tobytes() == b" " + batch[i] for words, side in zip((self.of_a, self.of_b), ids))]
        return [held[k] for k in good], [[side[k] for k in good] for side in ids]

    def block(self, batch: list[bytes]) -> dict[str, list]:
        """Counts, groups and pairs of some texts.

        ``pairs`` and ``sums`` are the distinct id pairs of the block and how many links hold
        each; ``places`` and ``times`` name for each text its pairs among them.
        """
        good, sides = self.tokens(batch)
        sizes_a, sizes_b = (np.array([len(x) for x in side], np.int64) for side in sides)
        a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in sides)
        ends_a, ends_b = np.cumsum(self.of_a.length[a]), np.cumsum(self.of_b.length[b])
        terminal = jump(ends_a, ends_b)
        last_b = terminal[len(a):] == np.arange(len(a), len(a) + len(b))
        groups = np.bincount(np.repeat(np.arange(len(good)), sizes_b)[last_b], minlength=len(good))
        at_a, at_b = links(ends_a, ends_b)
        owner = np.repeat(np.arange(len(good)), sizes_a)[at_a]
        span = self.of_a.size << ID_BITS
        own, times = np.unique(owner * span + (a[at_a] << ID_BITS | b[at_b]), return_counts=True)
        own_text, own_pair = np.divmod(own, span)
        pairs, place = np.unique(own_pair, return_inverse=True)
        sums = np.bincount(place, times, len(pairs)).astype(np.int64)
        n_links, n_own = np.bincount(owner, minlength=len(good)), np.bincount(own_text, minlength=len(good))
        n = len(batch)
        out = {name: [0] * n for name in ("n_a", "n_b", "n_groups", "n_links")} | {
            "groups": [""] * n, "places": [[]] * n, "times": [[]] * n, "pairs": pairs, "sums": sums}
        starts = np.concatenate(([0], np.cumsum(n_own)))
        place, times = place.astype(np.int32), times.astype(np.int32)
        for k, (i, text) in enumerate(zip(good, self.texts(a, b, terminal, last_b, sizes_a, sizes_b))):
            out["n_a"][i], out["n_b"][i], out["n_groups"][i], out["n_links"][i] = (
                int(sizes_a[k]), int(sizes_b[k]), int(groups[k]), int(n_links[k]))
            out["groups"][i] = text
            out["places"][i], out["times"][i] = place[starts[k]:starts[k + 1]], times[starts[k]:starts[k + 1]]
        return out

    def texts(self, a, b, terminal, last_b, sizes_a, sizes_b) -> Iterator[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: groups in order, decimal ids."""
        rank = np.cumsum(last_b) - 1  # terminals in order of their bytes
        of_a, of_b = rank[terminal[:len(a)] - len(a)], rank[terminal[len(a):] - len(a)]
        last_a = np.append(of_a[1:] != of_a[:-1], [True] * bool(len(a)))
        n_a, n_b = self.of_a.size, self.of_b.size
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]] = a + n_a * last_a
        code[np.arange(len(b)) + np.cumsum(in_a)[of_b]] = 2 * n_a + b + n_b * last_b
        ends = np.cumsum(sizes_a + sizes_b)
        for start, end in zip(ends - sizes_a - sizes_b, ends):
            yield "".join(map(self.written.__getitem__, code[start:end].tolist()))[:-1]


def aligned_blocks(docs: DataFrame, a: str, b: str, pattern: str | None, hashed: bool) -> DataFrame:
    """Rows of texts (``pairs`` null) and rows of the pairs of each block of texts."""
    sent = docs.sparkSession.sparkContext.broadcast((a, b, pattern))
    kinds = {"block": pa.int64(), "doc_id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
             "groups": pa.string(), "places": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "start": pa.int32(),
             "pairs": pa.list_(pa.int64()), "sums": pa.list_(pa.int64())}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<bigint>",
             pa.int32(): "int", None: id_type}
    schema = ", ".join(f"{k} {names[v]}" for k, v in kinds.items())

    def rows(aligner: Aligner, block: int, ids: pa.Array, batch: list[bytes]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        found, n = aligner.block(batch), len(batch)
        if hashed:
            found["groups"] = [sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
        types = {**kinds, "doc_id": ids.type}
        columns = {**found, "block": [block] * n, "doc_id": ids, "start": None, "pairs": None, "sums": None}
        yield pa.RecordBatch.from_arrays(
            [ids if k == "doc_id" else pa.nulls(n, t) if columns[k] is None else pa.array(columns[k], t) for k, t in types.items()],
            names=list(types))
        for at in range(0, len(found["pairs"]), CHUNK):
            some = {"block": block, "start": at, "pairs": found["pairs"][at:at + CHUNK], "sums": found["sums"][at:at + CHUNK]}
            yield pa.RecordBatch.from_arrays(
                [pa.array([some[k]], t) if k in some else pa.nulls(1, t) for k, t in types.items()], names=list(types))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(*tokenizers_of(*sent.value)), TaskContext.get().partitionId() << 32
        for batch in batches:
            held, start, size = texts(batch.column(1)), 0, 0
            for i, text in enumerate(held):
                size += len(text)
                if size >= BLOCK_BYTES or i == len(held) - 1:
                    yield from rows(aligner, block, batch.column(0)[start:i + 1], held[start:i + 1])
                    block, start, size = block + 1, i + 1, 0

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``block, place, pair, n``: the distinct id pairs of each block."""
    rows = blocks.where("pairs IS NOT NULL").select("block", "start", F.posexplode(F.arrays_zip("pairs", "sums")).alias("i", "x"))
    return rows.select("block", (F.col("start") + F.col("i")).alias("place"), "x.pairs", "x.sums").toDF("block", "place", "pair", "n")


def id_of_b() -> Column:
    return F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")


def totals(pairs: DataFrame) -> DataFrame:
    """``pair, total, best`` over all texts; best: no other pair with its B id occurs more often.

    A B id has at most as many pairs as A has tokens, so the window's groups are bounded.
    """
    summed = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    same = Window.partitionBy(id_of_b())
    return summed.select("pair", "total", (F.col("total") == F.max("total").over(same)).alias("best"))


def files(a_path: str, b_path: str) -> tuple[str, str]:
    with open(a_path, encoding="utf-8") as file_a, open(b_path, "rb") as file_b:
        return file_a.read(), base64.b64encode(file_b.read()).decode()


def pair_counts(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None) -> DataFrame:
    """``a_id, b_id, n, best``: how many links of all texts join the two ids, and whether no
    other A id is linked more often with this B id."""
    blocks = Store(docs.sparkSession, "align").put(aligned_blocks(docs, *files(a_path, b_path), pattern, True))
    return totals(block_pairs(blocks)).select(
        F.shiftright("pair", ID_BITS).cast("int").alias("a_id"), id_of_b().alias("b_id"), F.col("total").alias("n"), "best")


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, hashed: bool = False,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each document.

    A is a byte-level BPE file, applied to a space and the text; B a sentencepiece model that
    adds the space.  Special tokens in a text are plain text.  ``groups`` is
    ``a1,a2|b1;a3|b2,b3``: the ids of A and B in each group of tokens that overlap, directly
    or through others; ``hashed`` gives its SHA-256 instead.  Links are the overlapping pairs
    of token occurrences.  ``n_best`` counts the links whose id pair is the most frequent of
    its B id in all texts, ties included; ``count_sum`` sums the pairs' totals over the links.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte
    (B: those with U+2581), have no tokens: zeros, and an empty ``groups``.  One row out for
    each row in, equal rows and null ids too; other columns are not read.  Texts are worked
    off whole.  Memory is bounded by a block of ``BLOCK_BYTES`` or the longest text.
    """
    blocks = Store(docs.sparkSession, "align").put(aligned_blocks(docs, *files(a_path, b_path), pattern, hashed))
    pairs = block_pairs(blocks)
    known = pairs.join(totals(pairs).hint("merge"), "pair").select("block", "place", "total", "best")
    held = blocks.where("pairs IS NULL").drop("start", "pairs", "sums")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def look_up(texts_of: pa.Table, block: pa.Table) -> pa.Table:
        place = np.asarray(block["place"])
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], best[place] = np.asarray(block["total"]), block["best"].to_numpy().astype(np.int64)
        where, times = texts_of["places"].combine_chunks(), texts_of["times"].combine_chunks()
        ends = np.concatenate(([0], np.cumsum(where.value_lengths().to_numpy(zero_copy_only=False))))
        flat, often = where.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        for name, value in (("n_best", best), ("count_sum", total)):
            sums = np.concatenate(([0], np.cumsum(value[flat] * often)))[ends]
            texts_of = texts_of.append_column(name, pa.array(sums[1:] - sums[:-1], pa.int64()))
        return texts_of.select(columns)

    kinds = dict(docs.select("doc_id").dtypes)
    schema = f"doc_id {kinds['doc_id']}, " + ", ".join(f"{c} bigint" for c in columns[1:-1]) + ", groups string"
    return held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(look_up, schema)
