import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from civicpulse.llm import gam, hnsw, outliers, preference
from civicpulse.llm.queries import LINE_WORDS, op3_quality, op6_embeddings, op8_preference, op10_outliers

from .test_cube import plain_targets
from .test_dedup import brute_lines, split_words
from .test_nearcopies import brute_copies
from .test_simhash import groups

FOLDER = "/root/testdata/sf0.01"


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


def test_quality_on_held_out_labels(spark):
    labels = dict(read(spark, "labels", "doc_id", "quality"))
    rows = op3_quality(spark, FOLDER).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(b for a, b in held if a)


def test_quality_fit_and_odd_rows(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction and nothing else
    model = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > .5) == y[3000:]).mean() > .9
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (3, "x" * 200_000, None), (3, "a b", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (3, 7)], "doc_id long, quality int")
    assert {r["score"] for r in gam.scored(docs, none).collect()} == {0.5}
    assert gam.scored(docs.limit(0), none).count() == 0
    assert gam.passing(docs, none).count() == 4


def plain_counts(text):
    words = split_words(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_outliers(spark):
    texts = dict(read(spark, "documents", "doc_id", "text"))
    labels = dict(read(spark, "labels", "doc_id", "quality"))
    rows = op10_outliers(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = plain_counts(texts[r["doc_id"]])
        assert counts == tuple(r[c] for c in outliers.COUNTS)
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    passed = [(labels[r["doc_id"]], r["kept"]) for r in rows if not r["base_failed"] and r["doc_id"] in labels]
    assert all(kept for quality, kept in passed if quality)
    assert sum(not kept for quality, kept in passed if not quality) >= 0.8 * sum(not q for q, _ in passed)


def test_outliers_odd_rows(spark):
    text = "a b c d\n \nx x x x x " + " ".join(f"w{i}" for i in range(60))
    assert outliers.text_counts(text.encode()) == plain_counts(text)
    assert outliers.text_counts("é|é\n\né|é\x1c".encode()) == plain_counts("é|é\n\né|é\x1c")
    rows = [(None, text, None, None, 1), (2, None, "en", "s", 1), (2, "", None, "s", 1), (3, "#$ " * 300_000, "en", None, 1)]
    rows += [(10 + i, text, "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mean int")
    got = outliers.judged(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 31
    assert outliers.judged(docs.limit(0)).count() == 0


def test_preferences_query(spark):
    turns = {}
    for conv, turn, role, text in sorted(read(spark, "conversations", "conv_id", "turn", "role", "text")):
        turns.setdefault(conv, []).append((role, text))
    rows = {r["pair_id"]: r for r in op8_preference(spark, FOLDER).collect()}
    assert set(rows) == set(turns)

    def shown(part):
        return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in part)
    for key, all_turns in turns.items():
        answers = [i for i, t in enumerate(all_turns) if t[0] == "assistant"]
        end = answers[-1] + 1 if answers else len(all_turns)
        chosen = all_turns[:end]
        rejected = chosen[:-1] + ([all_turns[answers[-2]]] if len(answers) > 1 else [])
        shared = 0
        while shared < min(len(chosen), len(rejected)) and chosen[shared] == rejected[shared]:
            shared += 1
        r = rows[key]
        assert (r["n_shared"], r["prompt"], r["chosen"], r["rejected"]) == (
            shared, shown(chosen[:shared]), shown(chosen[shared:]), shown(rejected[shared:]))
        for side, spans in ((chosen, r["chosen_spans"]), (rejected, r["rejected_spans"])):
            whole = shown(side[shared:])
            assert [whole[a:b] for a, b in spans] == [t + "<|end|>\n" for role, t in side[shared:] if role == "assistant"]


def test_preferences_odd_rows(spark):
    rows = [(1, 0, "user", None, 1), (1, None, None, "x", 1), (1, 0, "user", None, 1), (None, 1, "user", "y", 1), (2, 5, "assistant", "é🙂", 1), (2, 9, "assistant", "q", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    pairs = preference.earlier_answer_pairs(turns)
    assert sorted(r["pair_id"] for r in preference.preferences(pairs).collect()) == [1, 2]
    sides = "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt int"
    a, b = ("user", "hi"), ("assistant", "yo")
    odd = spark.createDataFrame([(1, None, None, 0), (2, [a, b], [a, b], 0), (3, [a], [b], 0), (None, [a, b], [a], 0)], sides)
    got = sorted(((r["pair_id"] or 0, r["n_shared"], bool(r["prompt"]), bool(r["chosen"]), bool(r["rejected"])) for r in preference.preferences(odd).collect()))
    assert got == [(0, 1, True, True, False), (1, 0, False, False, False), (2, 2, True, False, False), (3, 0, False, True, True)]
    assert preference.preferences(odd.limit(0)).count() == 0


def plain_links(rows, least=0.93):
    good = [(k, np.array(v, float), l) for k, v, l in rows if k is not None and l is not None and v and all(
        c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {k: 0 for k, *_ in rows}
    edges = []
    for i, (a, x, l) in enumerate(good):
        for b, y, m in good[i + 1:]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    return links, groups(edges, [k for k, *_ in rows if k is not None])


@pytest.mark.parametrize("shard", [6000, 40])
def test_embeddings(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "PER_SHARD", shard)
    rows = read(spark, "embeddings", "vec_id", "embedding", "label")
    links, group = plain_links(rows)
    got = op6_embeddings(spark, FOLDER).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert {r["vec_id"]: r["component_id"] for r in got} == group
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1),
            (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, 0) for r in rows] + [(None, [1.0, 0.0], 1, 0)], "vec_id long, embedding array<float>, label int, rep int")
    links, group = plain_links(rows)
    got = hnsw.near_duplicates(frame).collect()
    assert len(got) == 14
    assert {r["vec_id"]: r["n_links"] for r in got if r["vec_id"]} == links
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"]} == group
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_graph_finds_clusters():
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(30, 16))
    x = hnsw.unit(np.concatenate([c + .05 * draw.normal(size=(n, 16)) for c, n in zip(centers, [300, *[8] * 29])] + [draw.normal(size=(800, 16))]))
    assert (hnsw.matches(hnsw.Graph(x, 1), x, x, .93) == (x @ x.T >= .93)).mean() > .99999


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = dict(read(spark, "labels", "doc_id", "quality"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, FOLDER).persist()
    kept = {r["doc_id"] for r in good.collect()}
    assert all(k in kept for k, q in labels.items() if q) and good.columns == docs.columns
    assert sum(k not in kept for k, q in labels.items() if not q) >= .9 * sum(not q for q in labels.values())
    cut = stages["line_dedup"](spark, good, FOLDER).persist()
    want = {k: t for k, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in good.collect()], 3, LINE_WORDS)}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want and cut.columns == docs.columns
    near = stages["near_dedup"](spark, cut, FOLDER).persist()
    assert {r["doc_id"] for r in near.collect()} == set(brute_copies(list(want.items())).values())
    mixed = stages["mix"](spark, near, FOLDER).persist()
    sizes, taken, largest = Counter(), Counter(), {}
    for r in near.collect():
        sizes[r["source"]] += len(split_words(r["text"]))
        largest[r["source"]] = max(largest.get(r["source"], 0), len(split_words(r["text"])))
    for r in mixed.collect():
        taken[r["source"]] += len(split_words(r["text"]))
    targets = plain_targets(dict(sizes))
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    out = stages["tokenize"](spark, mixed, FOLDER)
    assert out.count() == mixed.count() == corpus_pipeline.run(spark, FOLDER).count()
