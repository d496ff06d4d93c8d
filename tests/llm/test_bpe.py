import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from civicpulse.llm import bpe
from civicpulse.llm.bpe import Transducer, Utf8Stream, decode_text, encode_documents, merged, parse_ranks
from civicpulse.llm.queries import RANKS, op1_bpe

PATH = P.path(RANKS)


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return parse_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("most_states", [1, 20, 100_000])
def test_pieces_equal_the_merges(ranks, most_states):
    machine = Transducer(ranks, most_states=most_states, most_pieces=50)
    draw = random.Random(5)
    pieces = [bytes(draw.choices(b"abehnort \xc3\xa9\xf0", k=draw.randrange(1, 24))) for _ in range(1500)]
    for piece in [*pieces, b"a" * 3000, b" " * 700, b"ab" * 900]:
        wanted = [ranks[piece]] if piece in ranks else [ranks[t] for t in merged(ranks, piece)] if len(piece) < 99 else None
        got = list(machine.encode(piece))
        assert b"".join(machine.token[t] for t in got) == piece
        assert wanted is None or got == wanted


def test_histories_meet_in_states(spark, ranks):
    """A state for every second piece at most; most bytes need no new move; nothing is left
    to another way."""
    machine, find = Transducer(ranks), regex.compile(P.PATTERN).findall
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.coalesce("text", F.lit(""))).collect()
    pieces = sorted({w.encode() for (t,) in docs for w in find(t)} - set(ranks))
    first = [machine.encode(p) for p in pieces]
    states, moves = len(machine.states), len(machine.moves)
    assert states < len(pieces) / 2 and moves < sum(map(len, pieces)) / 4
    assert [machine.encode(p) for p in pieces] == first and (len(machine.states), len(machine.moves)) == (states, moves)


def test_output_lags_by_a_bounded_number_of_bytes(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    machine, whole, draw = Transducer(ranks), Transducer(ranks), random.Random(2)
    longest = max(map(len, ranks))
    held = []
    certain = machine.certain
    monkeypatch.setattr(machine, "certain", lambda state, last: held.append(len(last) - certain(state, last)) or certain(state, last))
    piece = bytes(draw.choices(b"abehnort", k=20_000)) + b"ab" * 5000
    got = machine.encode(piece)
    monkeypatch.setattr(bpe, "CHUNK", 1 << 20)
    assert got == whole.encode(piece) and b"".join(map(machine.token.get, got)) == piece
    assert len(held) > 400 and max(held) <= 4 * longest


def test_documents_equal_the_library(spark, library):
    odd = [None, "", " ", "  a  b\n\n c ", "don't I'LL we've", "naïve 漢字 🙂👩‍🚀 é", "\x1c\x85　x", "a" * 50_000,
           "\n" * 3000, "é" * 9999, "a", "a"]
    docs = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(odd)], "doc_id int, text string, ids int")
    rows = encode_documents(docs, PATH, P.PATTERN, fields=("n_tokens", "ids", "decoded")).collect()
    assert len(rows) == len(odd)
    for row in rows:
        text = odd[row["doc_id"] or 0] or ""
        assert row["ids"] == library.encode_ordinary(text) and row["n_tokens"] == len(row["ids"])
        assert row["decoded"] == text
    assert encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op1_bpe(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(got) == len(rows)
    for key, text in rows:
        ids = library.encode_ordinary(text)
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_streaming_decode():
    data = "aé漢🙂".encode() + b"\xff\xc3" + "z".encode() + b"\xf0\x9f"
    for size in range(1, 7):
        stream = Utf8Stream()
        text = "".join(stream.feed(data[i:i + size]) for i in range(0, len(data), size)) + stream.close()
        assert text == data.decode("utf-8", "replace")
    assert decode_text({0: b"\xf0\x9f", 1: b"\x99\x82"}, [0, 1, 0]) == "🙂�"
