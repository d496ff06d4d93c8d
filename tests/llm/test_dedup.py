import hashlib
import random
from collections import Counter, defaultdict

import pytest

from civicpulse.llm import lines, phrases
from civicpulse.llm.queries import op4_lines, op5_phrases


def split_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_phrases(rows, window):
    seen, split = Counter(), [split_words(t or "") for _, t in rows]
    for words in split:
        seen.update(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    for (key, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        yield key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def brute_lines(rows, run, words=None):
    """rows: distinct (doc_id, text), ids distinct"""
    gone = defaultdict(set)
    for size, least in [(run, 1), *([(1, words)] if words else [])]:
        seen, split = defaultdict(list), {}
        for key, text in rows:
            split[key] = [(i, x) for i, x in enumerate((text or "").split("\n")) if len(split_words(x)) >= least]
            for i in range(len(split[key]) - size + 1):
                seen[tuple(x for _, x in split[key][i:i + size])].append((key, i))
        for places in seen.values():
            for key, i in sorted(places)[1:]:
                gone[key].update(p for p, _ in split[key][i:i + size])
    for key, text in rows:
        every = text.split("\n") if text is not None else []
        yield key, len(every), len(gone[key]), None if text is None else "\n".join(
            x for i, x in enumerate(every) if i not in gone[key])


def drawn(seed, breaks):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é\xa0", "x\x1cy"]
    passages = [[draw.choice(words) for _ in range(draw.randrange(3, 40))] for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(0, 6)):
            part = draw.choice(passages) if draw.random() < .5 else [draw.choice(words) for _ in range(draw.randrange(30))]
            parts += part[draw.randrange(4):] if draw.random() < .3 else part
        texts.append("".join(w + draw.choice(breaks) for w in parts))
    return texts + ["", "a " * 13, "b " * 9 + "c", "q\n" * 40, "z " * 12, "z " * 11, *texts[:5]]


@pytest.mark.parametrize("common", [2, 1000])
def test_phrases_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(phrases, "COMMON", common)
    monkeypatch.setattr(phrases, "GRAM", 4)
    rows = list(enumerate(drawn(1, "  \n\t")))
    rows += [(900, None), (901, rows[3][1])]
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id int, text string, k1 int")
    for window in (2, 10):
        got = sorted(tuple(r) for r in phrases.deduplicated(frame, window).drop("kept").collect())
        assert got == sorted(brute_phrases(rows, window))
    equal = spark.createDataFrame([(None, "a b c d e f g h i j k")] * 4 + [(5, "x")], "doc_id int, text string")
    assert sorted(r["n_removed"] for r in phrases.deduplicated(equal, 10).collect()) == [0, 11, 11, 11, 11]
    assert phrases.deduplicated(frame.limit(0), 10).count() == 0


def test_lines_equal_brute_force(spark):
    rows = list(enumerate(drawn(2, "    \n\n")))
    rows += [(900, None), (901, rows[3][1]), (902, "\n \n\n" * 30), (903, "\n \n\n" * 30)]
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id int, text string, row int")
    for run in (1, 2, 3):
        got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in lines.deduplicated(frame, run).collect()), key=repr)
        assert got == sorted(brute_lines(rows, run), key=repr)
    for words in (2, 5):
        got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in lines.deduplicated(frame, 3, words).collect()), key=repr)
        assert got == sorted(brute_lines(rows, 3, words), key=repr)
    assert lines.deduplicated(frame).columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    assert lines.deduplicated(frame.limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a\nb\nc"), (7, "a\nb\nc"), (8, "a\nb\nc"), (8, "a\nb\nc")], "doc_id int, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in lines.deduplicated(ids).collect()) == [
        ("7", "a\nb\nc"), ("8", ""), ("8", ""), ("None", "")]


def test_queries_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op5_phrases(spark, folder).collect()) == sorted(brute_phrases(rows, 35))
    want = sorted((k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute_lines(rows, 3, 8))
    assert sorted(tuple(r) for r in op4_lines(spark, folder).collect()) == want


def test_no_long_line_is_left_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    seen = Counter(x for r in lines.deduplicated(docs, 3, 8).collect() for x in (r["text"] or "").split("\n") if len(split_words(x)) >= 8)
    assert max(seen.values()) == 1


def test_lines_of_odd_columns_and_long_texts(spark):
    long = "\n".join(f"line {i} with quite a few words in it for sure" for i in range(20_000))
    rows = [(1, long, 5, {"a": 1}, 7.5, "x"), (2, "head\n" + long, 6, None, None, None), (3, None, 1, {}, 1.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, `a.b` map<string,int>, _row double, places string")
    got = {r["doc_id"]: r for r in lines.deduplicated(docs, 3, 8, counts=False).collect()}
    assert lines.deduplicated(docs, counts=False).columns == docs.columns
    assert got[1]["text"] == long and got[2]["text"] == "head" and got[3]["text"] is None
    assert [got[i]["n_lines"] for i in (1, 2, 3)] == [5, 6, 1] and got[1]["a.b"] == {"a": 1} and got[1]["_row"] == 7.5
    counted = {r["doc_id"]: r["n_lines"] for r in lines.deduplicated(docs, 3, 8).collect()}
    assert counted == {1: 20_000, 2: 20_001, 3: 0}


@pytest.mark.parametrize("seed", range(30))
def test_passages_of_a_shard_equal_brute_force(seed):
    draw = random.Random(seed)
    window, words = 4, [b"%d" % i for i in range(6 if seed % 2 else 60)]
    passages = [[draw.choice(words) for _ in range(draw.randrange(4, 12))] for _ in range(6)]
    stretches, counts = [], []
    for _ in range(30):
        part = draw.choice(passages)
        part = part[draw.randrange(3):len(part) - draw.randrange(3)] if draw.random() < .5 else part
        stretch = [draw.choice(words) for _ in range(draw.randrange(4))] + part + [draw.choice(words) for _ in range(draw.randrange(4))]
        stretches.append(stretch[:30])
        counts.append(draw.choice([1, 1, 1, 3]))
    seen = Counter()
    for stretch, n in zip(stretches, counts):
        for i in range(len(stretch) - window + 1):
            seen[tuple(stretch[i:i + window])] += n
    want = [sum(1 << i for i in range(len(s) - window + 1) if seen[tuple(s[i:i + window])] > 1) for s in stretches]
    assert phrases.located(stretches, counts, window) == want
