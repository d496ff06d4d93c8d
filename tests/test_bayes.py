from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from civicpulse.functions import text
from civicpulse.operators import bayes
from civicpulse.sources import readers, writers

DOCS = [
    ("good sunny place", "positive"), ("good good food", "positive"), ("bad place", "negative"),
    ("good bad", "neutral"), ("ignored words", "irrelevant"),
]


def features(words):
    words = words.split()
    return set(words) | {f"{a}\u0001{b}" for a, b in zip(words, words[1:])}


def by_hand(docs):
    docs = [(features(t), label) for t, label in docs if label != "irrelevant"]
    sizes = Counter(label for _, label in docs)
    df = Counter(f for fs, _ in docs for f in fs)
    seen = Counter((label, f) for fs, label in docs for f in fs)
    prior = {l: log((n + 0.5) / (len(docs) + 0.5 * len(sizes))) for l, n in sizes.items()}
    bins = {f: 1 if df[f] == len(docs) else 2 for f in df}
    like = {(l, f): log((seen[l, f] + 0.5) / (sizes[l] + 0.5 * bins[f])) for l in sizes for f in df}
    return prior, like, seen


def winner(words, prior, like):
    known = [f for f in features(words) if any((l, f) in like for l in prior)]
    return max((round(prior[l] + sum(like[l, f] for f in known), 7), l) for l in prior)[1]


def corpus(spark, docs=DOCS):
    return spark.createDataFrame(docs, "text string, label string")


TOKENS = text.whitespace_tokens


def test_prior_and_likelihood_by_hand(spark):
    prior, like, seen = by_hand(DOCS)
    model = bayes.train(corpus(spark), tokens=TOKENS)
    got = {(r.label, r.feature): (r.n, r.logp) for r in model.likelihood().collect()}
    assert set(got) == set(like)
    for cell, (n, logp) in got.items():
        assert n == seen[cell] and logp == pytest.approx(like[cell], abs=1e-8)
    for table in (model.prior(), bayes.prior_table(corpus(spark))):
        assert {r.label: round(r.logp_nano / 1e9, 7) for r in table.collect()} == {
            l: round(p, 7) for l, p in prior.items()}


def test_pinned_values_of_four_documents(spark):
    model = bayes.train(corpus(spark), tokens=TOKENS)
    cell = {(r.label, r.feature): r.logp for r in model.likelihood().collect()}
    assert cell["positive", "good"] == pytest.approx(log(2.5 / 3), abs=1e-8)
    assert cell["negative", "good"] == pytest.approx(log(0.5 / 2), abs=1e-8)
    assert dict(model.labels) == {"positive": 2, "negative": 1, "neutral": 1}


def test_feature_of_every_document_has_one_bin(spark):
    docs = [("all a", "p"), ("all b", "n")]
    cell = {(r.label, r.feature): r.logp for r in bayes.train(corpus(spark, docs), tokens=TOKENS).likelihood().collect()}
    assert cell["p", "all"] == pytest.approx(log(1.5 / 1.5), abs=1e-8)
    assert cell["p", "a"] == pytest.approx(log(1.5 / 2), abs=1e-8)


ASKED = ["good food", "bad bad place", "unknown words", "", "sunny", "good bad", None]


@pytest.mark.parametrize("saved", [False, True])
def test_scores_and_fallbacks(spark, tmp_path, saved):
    model = bayes.train(corpus(spark), tokens=TOKENS)
    if saved:
        writers.save_model(model, str(tmp_path), "m")
        model = readers.load_model(spark, str(tmp_path), "m")
        assert model.is_small() and model.n_features > 0
    df = spark.createDataFrame(list(enumerate(ASKED)), "id int, text string")
    prior, like, _ = by_hand(DOCS)
    expected = {i: winner(t, prior, like) if t is not None else None for i, t in enumerate(ASKED)}
    for key in ("id", None):
        got = {r.id: r.sentiment for r in bayes.classify(df, model, key, tokens=TOKENS).collect()}
        assert got == expected


def test_ties_go_to_the_greatest_label(spark):
    model = bayes.train(corpus(spark, [("a", "x"), ("b", "y")]), tokens=TOKENS)
    df = spark.createDataFrame([(1, "zzz")], "id int, text string")
    assert bayes.score(df, model, "id", tokens=TOKENS).first().label == "y"


def test_copies_of_a_text_share_their_label(spark):
    model = bayes.train(corpus(spark), tokens=TOKENS)
    df = spark.range(500).select(F.when(F.col("id") % 2 == 0, "bad place").otherwise(
        F.concat(F.lit("good "), F.col("id").cast("string"))).alias("text"))
    got = Counter(r.sentiment for r in bayes.classify(df, model, tokens=TOKENS).collect())
    assert got == {"negative": 250, "positive": 250}


def test_token_copies_do_not_change_a_score(spark):
    model = bayes.train(corpus(spark), tokens=TOKENS)
    df = spark.createDataFrame([(1, "good good good"), (2, "good good")], "id int, text string")
    a, b = [r[1:] for r in bayes.score(df, model, "id", tokens=TOKENS).collect()]
    assert a == b


def test_no_model_gives_no_sentiment(spark, tmp_path):
    assert readers.load_model(spark, str(tmp_path), "missing") is None
    df = spark.createDataFrame([("x",)], "text string")
    assert bayes.classify(df, None).first().sentiment is None
    models = readers.load_models(spark, str(tmp_path), {"TWITTER": "a", "SKYSCRAPER": "a"})
    assert models == {"TWITTER": None, "SKYSCRAPER": None}


def test_informative_features_need_two_labels(spark):
    model = bayes.train(corpus(spark), tokens=TOKENS)
    _, like, seen = by_hand(DOCS)
    expected = {}
    for f in {f for _, f in like}:
        held = [like[l, f] for l in dict(model.labels) if seen[l, f]]
        if len(held) >= 2:
            expected[f] = max(held) - min(held)
    got = bayes.informative_features(model).collect()
    assert {r.feature: round(r.log_ratio_nano / 1e9, 6) for r in got} == {f: round(v, 6) for f, v in expected.items()}
    assert [r.log_ratio_nano for r in got] == sorted((r.log_ratio_nano for r in got), reverse=True)


def test_three_hundred_labels(spark):
    docs = [(f"l{i:03d}", f"own{i:03d} shared") for i in range(300)]
    model = bayes.train(spark.createDataFrame(docs, "label string, text string"), tokens=TOKENS)
    asked = spark.createDataFrame([(7, "own007"), (299, "own299 shared")], "id bigint, text string")
    got = {r.id: r.label for r in bayes.score(asked, model, "id", tokens=TOKENS).select("id", "label").collect()}
    assert got == {7: "l007", 299: "l299"}
    assert model.likelihood().where("feature = 'shared'").count() == 300


def test_weights_count_in_the_size_of_a_model(spark):
    features = spark.createDataFrame([("a", 1)], "feature string, n bigint")
    few, many = [tuple((str(i), 1) for i in range(n)) for n in (2, 256)]
    assert bayes.Model(few, features, 1_000_000, 10_000_000).is_small()
    assert not bayes.Model(many, features, 1_000_000, 10_000_000).is_small()


def test_separator_as_a_token(spark):
    odd = spark.createDataFrame([("alpha &#1; beta",), ("<a\u0001b> c",), ("<a b> c",)], "text string")
    got = {(r["first"], r["second"]): r["n"] for r in bayes.pair_counts(odd).collect()}
    assert got[("alpha", "\u0001")] == 1 and got[("\u0001", "beta")] == 1


def test_a_stopped_save_leaves_the_version_before(spark, tmp_path):
    corpus = spark.createDataFrame([("good fine", "positive"), ("bad poor", "negative")], "text string, label string")
    writers.save_model(bayes.train(corpus), str(tmp_path), "m")
    later = bayes.train(corpus.where("label = 'positive'"))
    later.features.write.parquet(f"{tmp_path}/m/features-99999999999999999999-x")
    assert dict(readers.load_model(spark, str(tmp_path), "m").labels) == {"positive": 1, "negative": 1}
    writers.save_model(later, str(tmp_path), "m")
    assert dict(readers.load_model(spark, str(tmp_path), "m").labels) == {"positive": 1}


def plain_bayes(rows, texts):
    """Labels and nano scores by the definition, over all labels."""
    from math import log
    from collections import Counter
    docs, pairs, df = Counter(l for _, l in rows), Counter(), Counter()
    feats = lambda t: set(t.split()) | {(a, b) for a, b in zip(t.split(), t.split()[1:])}
    for text, label in rows:
        for f in feats(text):
            pairs[f, label] += 1
            df[f] += 1
    nano = lambda p: round(log(p) * 10**9)
    out = []
    for text in texts:
        known = [f for f in feats(text) if f in df]
        score = {l: nano((n + .5) / (len(rows) + .5 * len(docs))) + sum(
            nano((pairs[f, l] + .5) / (n + .5 * (1 if df[f] == len(rows) else 2))) for f in known) for l, n in docs.items()}
        out.append(max((s, l) for l, s in score.items()))
    return out


def test_sparse_model_equals_the_definition(spark):
    import random
    draw = random.Random(8)
    words = [f"wo{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    text = lambda n: " ".join(["every", *(draw.choice(words) for _ in range(n))])
    rows = [(text(draw.randrange(6)), f"l{int(draw.random() ** 2 * 30)}") for _ in range(150)]
    texts = [text(draw.randrange(8)) for _ in range(60)] + ["", "unheard of", "every", words[0], words[1] + " xyzzy"]
    model = bayes.train_sparse(spark.createDataFrame(rows, "text string, label string"))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (round(r["score"] * 10**9), r["label"]) for r in bayes.score_sparse(df, model, "id").collect()}
    assert [got[i] for i in range(len(texts))] == plain_bayes(rows, texts)
    dense = bayes.train(spark.createDataFrame(rows, "text string, label string"))
    assert {r["id"]: r["label"] for r in bayes.score(df, dense, "id").collect()} == {i: l for i, (_, l) in got.items()}
    by_text = bayes.classify(df.withColumn("other", F.lit(1)), model)
    assert {r["id"]: r["sentiment"] for r in by_text.collect()} == {i: l for i, (_, l) in got.items()}


def test_five_thousand_labels(spark):
    rows = spark.range(20_000).selectExpr("'word' || char(97 + id % 25) || ' tail' || char(97 + id % 26) AS text", "'l' || id % 5000 AS label")
    model = bayes.train_sparse(rows)
    plan = model.pairs._jdf.queryExecution().optimizedPlan().toString()
    assert model.labels.count() == 5000 and "l4711" not in plan
    found = bayes.score_sparse(spark.createDataFrame([(1, "wordb tailc"), (2, "nothing")], "id int, text string"), model, "id").collect()
    want = plain_bayes([tuple(r) for r in rows.collect()], ["wordb tailc", "nothing"])
    assert {r["id"]: (round(r["score"] * 10**9), r["label"]) for r in found} == dict(enumerate(want, 1))


def test_sparse_scores_shuffle_no_label_of_a_text(spark):
    rows = [("one two", "a"), ("one three", "b"), ("two three", "c")]
    model = bayes.train_sparse(spark.createDataFrame(rows, "text string, label string"))
    texts = spark.createDataFrame([(1, "one two"), (1, "three"), (None, "two"), (None, "two"), (2, None)], "id int, text string")
    scored = bayes.score_sparse(texts, model, "id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(feature" in plan
    assert sorted(r["id"] or 0 for r in scored.collect()) == [0, 1]


def test_lookup_by_shuffle_agrees_however_it_is_joined(spark, monkeypatch):
    """Few texts are brought to the model, many are joined by hash or, with a large model, by sort."""
    rows = [(i % 7, f"w{i % 5} w{i % 3} w{i % 11} w{i}") for i in range(60)] + [(None, "w1 w2"), (8, ""), (9, None)]
    texts = spark.createDataFrame(rows, "k long, text string")
    corpus = spark.createDataFrame([(f"w{i % 4} w{i % 6} w{i % 9} w1", "ab"[i % 2]) for i in range(30)], "text string, label string")
    model = bayes.train(corpus)
    want = sorted(map(tuple, bayes.score(texts, bayes.Model(model.labels, model.features, 1, 1), "k").collect()), key=repr)

    def scored():
        found = bayes.score(texts, model, "k")
        plan = found._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, found.collect()), key=repr), plan

    got, few = scored()
    assert got == want and "ShuffledHashJoin" not in few
    monkeypatch.setattr(bayes, "FEW_BYTES", 0)
    got, many = scored()
    assert got == want and "ShuffledHashJoin" in many and "SortMergeJoin" not in many
    monkeypatch.setattr(bayes, "HASH_ROWS", 0)
    got, large = scored()
    assert got == want and "SortMergeJoin" in large


def test_packed_lists_hold_the_features_of_the_tokens(spark):
    """Features that tasks number and pack are those of the expression, odd tokens and all."""
    from civicpulse.operators import featurelists
    rows = ["a b a b c", "a", "", None, "\u0001 \u0002 a\u0001b \u00021", "\u0001", "é b é", "c a"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").select(
        "id", text.features_of(F.split("text", " ")).alias("features"), text.joined_tokens(F.split("text", " ")).alias("words"))
    got = df.orderBy("id").collect()
    import pyarrow as pa
    found = featurelists.features_in(pa.array([r["words"] for r in got], pa.string()), 3)
    names = found.names.texts().to_pylist()
    held = [{names[j] for i, j in zip(found.rows, found.numbers) if i == k} for k in range(len(rows))]
    assert held == [set(r["features"] or []) for r in got] and len(names) == len(set(names))
    assert featurelists.names_in(featurelists.unpack(pa.scalar(featurelists.pack(**featurelists.pack_names(found.names))))).texts().to_pylist() == names
    alone = featurelists.features_in(pa.array(["b\u0001a", "a\u0001b\u0001c"], pa.string()), 3)
    parts = lambda f: {n: p for p, a, b in f.parts for n in f.names.texts().to_pylist()[a:b]}
    assert len(parts(found)) == len(names) and all(parts(found)[n] == p for n, p in parts(alone).items())


def test_sparse_scores_move_lists_not_rows(spark, monkeypatch, tmp_path):
    """Training and lookup shuffle packed lists: a few rows for each task and part, whatever the number of features.
    Small pieces and sums give the same."""
    import random
    from civicpulse.operators import featurelists
    draw = random.Random(4)
    rows = [(i if i % 9 else None, f"l{i % 12}", " ".join(f"w{chr(97 + int(draw.random() ** 2 * 26))}" for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    model = bayes.train_sparse(df)
    assert model.lists.count() <= model.parts < model.pairs.count()
    scored = bayes.score_sparse(df, model, "id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "explode(features" not in plan and "hashpartitioning(feature_part" in plan
    want = sorted(map(tuple, scored.collect()), key=repr)
    assert len(want) == len({r[0] for r in rows})
    small, add = {"CELLS": 7, "PIECE_BYTES": 50}, featurelists.scored("id", model.parts)

    def held(sizes):
        # In the task, and back again: its process goes on to other tasks.
        before = {name: getattr(featurelists, name) for name in sizes}
        for name, size in sizes.items():
            setattr(featurelists, name, size)
        return before

    def in_small_steps(texts, answers):
        before = held(small)
        try:
            return add(texts, answers)
        finally:
            held(before)

    monkeypatch.setattr(featurelists, "scored", lambda key, parts: in_small_steps)
    assert sorted(map(tuple, bayes.score_sparse(df, model, "id").collect()), key=repr) == want
    pairs = lambda m: sorted(map(tuple, m.pairs.collect()), key=repr)
    count = featurelists.counted(model.parts)

    def in_small_pieces(batches):
        before = held(small)
        try:
            yield from count(batches)
        finally:
            held(before)

    monkeypatch.setattr(featurelists, "counted", lambda parts: in_small_pieces)
    assert pairs(bayes.train_sparse(df)) == pairs(model)


def test_many_texts_look_a_large_model_up_by_lists(spark, monkeypatch):
    """Scores by packed lists are those of the broadcast model; no feature of a text is a row of a shuffle."""
    rows = [(i % 7, f"w{i % 5} w{i % 3} w{i % 11} w{i}") for i in range(60)] + [
        (None, "w1 w2"), (None, "w1 \u0001 w2"), (8, ""), (9, None), (10, "unheard of")]
    texts = spark.createDataFrame(rows, "k long, text string")
    corpus = [(f"w{i % 4} w{i % 6} w{i % 9} w1 \u0001", "abc"[i % 3]) for i in range(30)]
    model = bayes.train(spark.createDataFrame(corpus, "text string, label string"), tokens=TOKENS)
    want = sorted(map(tuple, bayes.score(texts, bayes.Model(model.labels, model.features, 1, 1), "k", tokens=TOKENS).collect()), key=repr)
    monkeypatch.setattr(bayes, "MANY_BYTES", 0)
    for size in (bayes.PART_FEATURES, 3):
        monkeypatch.setattr(bayes, "PART_FEATURES", size)
        found = bayes.score(texts, model, "k", tokens=TOKENS)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(feature_part" in plan and "hashpartitioning(feature#" not in plan and "hashpartitioning(k" not in plan
        assert sorted(map(tuple, found.collect()), key=repr) == want and len(want) == 10
