"""Byte-level BPE encoding and decoding.

A token sequence is the BPE encoding of a piece exactly if each token encodes itself and
each two neighbours encode their joined bytes as just these two.  That makes encoding a
finite-state matter: a nondeterministic machine guesses token ends, and a pair table says
which token may follow which.  ``Transducer`` determinises it while it reads.

A state holds the guesses that are still open: the token before, and the trie node of the bytes
since.  Of the token before, only that counts which decides the future: which of the tokens
below the node may follow it.  So guesses that agree in this are one, guesses that nothing can
follow are dropped, and histories that differ meet in one state again.  A move tells the token
that ends here, which is the only one, as every prefix of a piece has one encoding.  Tokens go
out as soon as all open guesses share them, so output lags by a bounded number of bytes.

Decoding concatenates token bytes in chunks; ``Utf8Stream`` keeps back an unfinished
character at the end of a chunk until its other bytes arrive.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts

#: Bytes, or tokens, worked off at a time.
CHUNK = 4096
#: First bytes of a piece whose state is remembered.
HEAD = 4
#: So many tokens below a trie node are looked at to find guesses with the same future.
FEW = 32


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(ranks: dict[bytes, int], piece: bytes, until: int = 1) -> list[bytes]:
    """The definition of BPE: join the neighbours of lowest rank, leftmost first.

    Stops early when ``until`` parts are left.
    """
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > until:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Bytes of one piece in, token ids out.

    ``most_states`` and ``most_pieces`` bound the memory, not the results: with that many
    states the machine starts its tables anew, going on from the state it is in; of the
    remembered pieces it forgets the oldest half.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 100_000, most_pieces: int = 150_000):
        self.ranks, self.most_states, self.most_pieces = ranks, most_states, most_pieces
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                after = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if after == len(self.token_at):
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token_at[node] = rank
        self.below = self.tokens_below()
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        self.forget()

    def forget(self) -> None:
        """Empty tables of states."""
        self.pairs: dict[int, bool] = {}
        self.classes: dict[tuple, tuple[int, int]] = {}
        self.guesses: dict[int, tuple[int, int] | None] = {}
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        self.start = self.state(((-1, 0),))

    def tokens_below(self) -> list[tuple[int, ...] | None]:
        """For each node the tokens longer than its bytes that begin with them; None if many."""
        out: list[list[int] | None] = [[] for _ in self.token_at]
        parent = [0] * len(self.token_at)
        for key, node in self.child.items():
            parent[node] = key >> 8
        for node in range(1, len(self.token_at)):
            up, token = parent[node], self.token_at[node]
            while token >= 0:
                held = out[up]
                if held is not None:
                    held.append(token)
                    if len(held) > FEW:
                        out[up] = None
                if not up:
                    break
                up = parent[up]
        return [None if held is None else tuple(held) for held in out]

    def state(self, guesses: tuple) -> int:
        found = self.number.get(guesses)
        if found is None:
            found = self.number[guesses] = len(self.states)
            self.states.append(guesses)
        return found

    def spine(self, rank: int) -> tuple[list, list] | None:
        """How a token came about at its edges, latest first; None if merging never makes it.

        The first list follows the right edge, the second the left one: tokens with their
        own rank (-1 for a byte) and the rank of the merge that consumed them.
        """
        if rank in self.spines:
            return self.spines[rank]
        token, out = self.token[rank], None
        if len(token) == 1:
            out = [(token, -1, len(self.ranks))], [(token, -1, len(self.ranks))]
        else:
            halves = merged(self.ranks, token, 2)
            if len(halves) == 2:
                edges = self.spine(self.ranks[halves[1]]), self.spine(self.ranks[halves[0]])
                if None not in edges:
                    # A half was there until this token's merge consumed it.
                    out = tuple(
                        [(token, rank, len(self.ranks)), (*edge[side][0][:2], rank), *edge[side][1:]]
                        for side, edge in enumerate(edges))
        self.spines[rank] = out
        return out

    def follows(self, before: int, token: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the same two tokens.

        Goes back in time through the tokens that met at the boundary.  Where their join is
        a token of lower rank than the merges that consumed them, it would have come first
        (on a tie the leftmost merge does).
        """
        right = self.spine(token)
        if before < 0 or right is None:
            return right is not None
        left, right, i, j = self.spine(before)[0], right[1], 0, 0
        while True:
            (x, made_x, until_x), (y, made_y, until_y) = left[i], right[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i += 1
            else:
                j += 1

    def pair(self, before: int, token: int) -> bool:
        """``follows``, remembered."""
        key = (before + 1) << 32 | token
        fits = self.pairs.get(key)
        if fits is None:
            fits = self.pairs[key] = self.follows(before, token)
        return fits

    def guess(self, before: int, node: int) -> tuple[int, int] | None:
        """The open guess that stands for all with the same future; None if there is none."""
        key = (before + 1) << 32 | node
        if key in self.guesses:
            return self.guesses[key]
        tokens, found = self.below[node], (before, node)
        if tokens is not None:
            may = tuple(t for t in tokens if self.follows(before, t))
            found = self.classes.setdefault((node, may), found) if may else None
        self.guesses[key] = found
        return found

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the token that ends here; built when first needed."""
        after, last = [], -1
        for before, node in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if last < 0 <= token and self.pair(before, token):
                last = token
            open_ = self.guess(before, node)
            if open_:
                after.append(open_)
        after.append((last, 0))
        out = self.moves[state << 8 | byte] = (self.state(tuple(after)), last)
        return out

    def tokens(self, last: list[int], end: int) -> list[int]:
        """The tokens up to a position, from the last token of every prefix."""
        out, size = [], self.size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def certain(self, state: int, last: list[int]) -> int:
        """Up to which position all open guesses share their tokens."""
        ends = {len(last) - self.depth[node] for _, node in self.states[state]}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.size[last[end - 1]])
        return ends.pop()

    def head(self, piece: bytes) -> tuple[int, tuple[int, ...]]:
        """The state after the first bytes of a piece and the last tokens of their prefixes,
        remembered: many pieces begin alike."""
        state, last = self.start, []
        for byte in piece[:HEAD]:
            state, token = self.moves.get(state << 8 | byte) or self.move(state, byte)
            last.append(token)
        found = self.heads[piece[:HEAD]] = (state, tuple(last))
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most_states:
            self.forget()
        state, last = self.heads.get(piece[:HEAD]) or self.head(piece)
        moves, last, out = self.moves.get, list(last), []
        for byte in piece[HEAD:CHUNK]:
            state, token = moves(state << 8 | byte) or self.move(state, byte)
            last.append(token)
        for start in range(CHUNK, len(piece), CHUNK):
            sure = self.certain(state, last)
            out += self.tokens(last, sure)
            del last[:sure]
            if len(self.states) > self.most_states:
                held = self.states[state]
                self.forget()
                state = self.state(held)
            for byte in piece[start:start + CHUNK]:
                state, token = self.moves.get(state << 8 | byte) or self.move(state, byte)
                last.append(token)
        return out + self.tokens(last, len(last))

    def pieces(self, pieces: list[str]) -> list[tuple[tuple[int, ...], str]]:
        """Of each piece the token ids and the same as decimals joined by commas, remembered."""
        found = list(map(self.known.get, pieces))
        for place in [i for i, x in enumerate(found) if x is None]:
            piece = pieces[place]
            held = self.known.get(piece) or self.older.get(piece)
            if held is None:
                ids = self.encode(piece.encode())
                held = (tuple(ids), ",".join(map(str, ids)))
            if len(piece) <= 64:
                if len(self.known) >= self.most_pieces:
                    self.older, self.known = self.known, {}
                self.known[piece] = held
            found[place] = held
        return found


class Utf8Stream:
    """Incremental UTF-8: ``feed`` gives the text that is complete, ``close`` the rest.

    The state between chunks is what the character begun last still lacks, with its bytes so
    far; it is kept by the standard library's incremental decoder.
    """

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", True)


def decode_chunks(token: dict[int, bytes], ids: Iterable[int]) -> Iterator[bytes]:
    """Bytes of the tokens, some thousands of tokens at a time."""
    ids = list(ids)
    for at in range(0, len(ids), CHUNK):
        yield b"".join(map(token.__getitem__, ids[at:at + CHUNK]))


def decoded(token: dict[int, bytes], ids: Iterable[int]) -> Iterator[str]:
    """Text of the tokens, streamed; bytes that are no UTF-8 become U+FFFD."""
    stream = Utf8Stream()
    yield from map(stream.feed, decode_chunks(token, ids))
    yield stream.close()


def decode_text(token: dict[int, bytes], ids: Iterable[int]) -> str:
    return "".join(decoded(token, ids))


COMPILED: dict[bytes, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The worker's transducer for a rank file; later tasks of the worker use it again."""
    if data not in COMPILED:
        COMPILED.clear()
        COMPILED[data] = Transducer(parse_ranks(data))
    return COMPILED[data]


FIELDS = {
    "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
    "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
    fields: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """Encode every text piece by piece (the matches of ``pattern``) and decode the ids again.

    Returns the id column and ``fields``: ``n_tokens``, ``ids`` (array), ``ids_sha256`` (of
    decimals joined by commas), ``decoded`` (text of the ids), ``decoded_sha256`` (of their
    bytes).  No special tokens.  A null text counts as empty: no tokens, hashes of nothing.
    Rows are independent: one row out per row in, null and repeated ids included; other
    columns are not read.  A long text is worked off piece by piece; memory per worker is
    bounded by the tables of ``Transducer`` and one Arrow batch.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([docs.schema[id_column], *[T.StructField(f, FIELDS[f]) for f in fields]])
    sha, names = hashlib.sha256, (id_column, *fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(ranks.value)
        find, lookup, token = regex.compile(pattern).findall, machine.pieces, machine.token
        for batch in batches:
            out = {f: [] for f in fields}
            for text in texts(batch.column(1)):
                pieces = lookup(find(text.decode("utf-8", "replace")))
                ids = list(chain.from_iterable(p[0] for p in pieces))
                if "n_tokens" in out:
                    out["n_tokens"].append(len(ids))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(sha(",".join([p[1] for p in pieces]).encode()).hexdigest())
                if "ids" in out:
                    out["ids"].append(ids)
                if "decoded" in out:
                    out["decoded"].append(decode_text(token, ids))
                if "decoded_sha256" in out:
                    digest = sha()
                    for part in decoded(token, ids):
                        digest.update(part.encode())
                    out["decoded_sha256"].append(digest.hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            arrays = [pa.array(out[f], types.get(f, pa.string())) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=list(names))

    return docs.select(id_column, text_column).mapInArrow(run, schema)
