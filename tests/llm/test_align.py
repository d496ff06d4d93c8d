import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from civicpulse.llm import align
from civicpulse.llm.queries import ALIGNED, op12_align

FOLDER = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(x) for x in ALIGNED]
ODD = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> and <s> </s> <unk>", "tab\tnew\nline\r\n", "▁ mark", "mark▁",
       "日本語 テキスト 😀👍🏽 é", "\x00\x01\x7f", "ſſ ŉ ͸ \U0001fadf", "a" * 3000, "ab " * 2000, "  x", "I'll 's 'S don't", "١٢٣ 12345"]


def brute(rows):
    """Per (doc_id, text): the columns of the query, by comparing all pairs of tokens."""
    a_tok = Tokenizer.from_file(PATHS[0])
    a_tok.encode_special_tokens = True
    b_tok = SentencePieceProcessor(model_file=PATHS[1])
    letters = align.byte_letters()
    as_bytes_a = lambda i: bytes(letters[c] for c in a_tok.id_to_token(i))
    as_bytes_b = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    parts, counts = [], Counter()
    for doc, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(map(as_bytes_a, a)) != whole or b"".join(map(as_bytes_b, b)) != whole:
            a, b = [], []
        spans = []
        for ids, as_bytes in ((a, as_bytes_a), (b, as_bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(as_bytes(i)), i))
                at = out[-1][1]
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            sides = [",".join(str(i) for s, e, i in side if start <= s < cut) for side in spans]
            groups.append("|".join(sides))
            start = cut
        links, low = [], 0
        for s, e, i in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        counts.update(links)
        parts.append((doc, len(a), len(b), groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [(doc, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
             ";".join(groups)) for doc, n_a, n_b, groups, links in parts], counts, most


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (3, "a"), (None, "a"), (None, None)]
    docs = spark.createDataFrame([(k, t, 0, "g", 1) for k, t in rows], "doc_id long, text string, n_a int, block string, pairs int")
    want, counts, most = brute(rows)
    got = align.align_documents(docs, *PATHS, public_tokenizers.PATTERN).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in want) and [r[1] for r in want if r[0] in (7, 8)] == [0, 0]
    pairs = align.pair_counts(docs, *PATHS).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs} == counts
    assert all(r["best"] == (r["n"] == most[r["b_id"]]) for r in pairs)
    assert align.align_documents(docs.limit(0), *PATHS).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)[0]]
    found = op12_align(spark, FOLDER)
    assert sorted(map(tuple, found.select(*COLUMNS[:-1], "groups_sha256").collect())) == sorted(want)


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    whole = sorted(map(tuple, align.align_documents(docs, *PATHS, public_tokenizers.PATTERN, hashed=True).collect()))
    monkeypatch.setattr(align, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(align, "CHUNK", 7)
    small = align.align_documents(docs, *PATHS, public_tokenizers.PATTERN, hashed=True)
    assert sorted(map(tuple, small.collect())) == whole


@pytest.mark.parametrize("seed", range(20))
def test_jump_labels_the_groups(seed):
    draw = np.random.default_rng(seed)
    total = int(draw.integers(1, 200))
    ends = [np.unique(np.append(draw.integers(1, total + 1, int(draw.integers(0, total))), total)) for _ in range(2)]
    found = align.jump(*ends)
    cuts = np.intersect1d(*ends)
    group = [np.searchsorted(cuts, e) for e in ends]
    terminal = len(ends[0]) + np.searchsorted(ends[1], cuts)
    assert np.array_equal(found, terminal[np.concatenate(group)])
    a, b = align.links(*ends)
    starts = [np.concatenate(([0], e[:-1])) for e in ends]
    overlap = (starts[0][:, None] < ends[1]) & (starts[1] < ends[0][:, None])
    assert np.array_equal(np.stack((a, b)), np.stack(np.nonzero(overlap)))


def test_both_ways_to_encode_agree_on_all_characters():
    data = align.files(*PATHS)[0]
    side = align.ByteLevel(data, public_tokenizers.PATTERN)
    plain = align.ByteLevel(data)
    assert side.fast and not plain.fast
    texts = [f"x{c}1{c} {c}{c}.\t{c} {c}  {c}'{c}é" for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)])]
    assert [list(x) for x in side.encode(texts)] == plain.encode(texts)
