from pyspark.sql import functions as F

from civicpulse.operators import match


def texts(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, text string")


def test_mentions_keep_duplicates(spark):
    df = texts(spark, "Chicago or #chicago?", "#Chicago chicago", "new york city", "nothing", None)
    got = match.city_mentions(df, ["chicago", "new york city"]).select("id", "city").collect()
    assert sorted(map(tuple, got)) == [(0, "chicago"), (1, "chicago"), (1, "chicago")]


def test_phrase_match_finds_names_of_several_words(spark):
    df = texts(spark, "in #New  York City and new york", "york")
    got = match.city_mentions(df, ["New York City", "new york", "and"], phrase_match=True)
    assert sorted(r.city for r in got.collect()) == ["and", "new york", "new york", "new york city"]


def test_track_needs_all_terms_of_a_phrase(spark):
    df = texts(spark, "City of #JOBS: new york!", "jobs in new york city", "#jobs new york", "#jobs #New @york city.", None)
    kept = match.track_filter(df, match.phrase_list(["jobs"], ["new york city"]))
    assert sorted(r.id for r in kept.collect()) == [0, 3]


def test_phrases_are_every_pair(spark):
    phrases = match.track_phrases(spark, ["a", "b"], ["x", "y z"])
    assert sorted(r.phrase for r in phrases.collect()) == sorted(match.phrase_list(["a", "b"], ["x", "y z"]))
    assert match.phrase_list(["a"], ["y z"]) == ["#a y z"]


def test_language(spark):
    df = spark.createDataFrame([("en",), ("EN-gb",), ("fr",), (None,)], "lang string")
    assert sorted(r.lang for r in match.language_filter(df, ["en", "en-GB"]).collect()) == ["EN-gb", "en"]


def test_topic_fans_out_over_prefixes(spark):
    df = texts(spark, "new york city | bridges", "old boston", "boston").withColumnRenamed("text", "topic")
    got = match.topic_cities(df, ["New York", "new york city", "Boston"]).select("id", "city").collect()
    assert sorted(map(tuple, got)) == [(0, "New York"), (0, "new york city"), (2, "Boston")]


def test_mentions_need_no_join_or_shuffle(spark):
    plan = match.city_mentions(texts(spark, "x"), ["chicago"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_tables_equal_lists(spark):
    texts = ["#Jobs in new york City", "rome ROME #rome nice-rome", "of the and", "jobs york new", None, "", "the of", "new york new york"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    phrases = ["#jobs york", "the of", "rome", "of of THE", "nowhere of", "", "@rome", "new jobs"]
    table = spark.createDataFrame([(p,) for p in [*phrases, None]], "phrase string")
    got = {(r["id"], r["phrase"]) for r in match.tracked_phrases(df, table, "id").collect()}
    want = {(r["id"], p) for p in phrases if p for r in df.where(match.tracked(F.col("text"), [p])).collect()}
    assert got == want and len(want) > 6
    some = [p for p in phrases if p]
    assert sorted(r["id"] for r in match.track_filter_by(df, table, "id").collect()) == sorted(
        r["id"] for r in match.track_filter(df, some).collect())
    cities = ["Rome", "new york", "New York City", "rome", "the", ""]
    names = spark.createDataFrame([(c,) for c in cities], "city string")
    rows = lambda d: sorted((r["id"], r["city"]) for r in d.collect())
    assert rows(match.city_mentions_by(df, names)) == rows(match.city_mentions(df, cities[:-1], phrase_match=True))
    topics = df.withColumn("topic", F.lower("text"))
    starts = ["Rome", "ro", "NEW YORK", "of", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"]
    assert rows(match.topic_cities_by(topics, spark.createDataFrame([(c,) for c in starts], "city string"))) == rows(
        match.topic_cities(topics, starts))
    assert match.city_mentions_by(df, names.limit(0)).count() == 0
    assert match.tracked_phrases(df, table.limit(0), "id").count() == 0


def test_the_terms_of_a_text_move_once(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b"), (2, "c d"), (None, "d e"), (None, "a")], "id int, text string")
    table = spark.createDataFrame([("a b",), ("c a",), ("e a",), ("d",)], "phrase string")
    found = match.tracked_phrases(df, table, "id")
    assert "explode(present" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(((r["id"] or 0), r["phrase"]) for r in found.collect()) == [
        (0, "d"), (0, "e a"), (1, "a b"), (1, "c a"), (2, "a b"), (2, "c a"), (2, "d")]


def test_what_a_text_may_hold_is_not_shuffled(spark, monkeypatch):
    """Phrases come to the texts: no exchange lies above the join with them; by shuffle the rows are the same."""
    rows = [(i if i % 7 else None, " ".join(f"w{(i * j + j) % 23}" for j in range(1 + i % 9))) for i in range(60)]
    df = spark.createDataFrame([*rows, (3, "w1 w2 w1"), (3, "#w1 w2"), (None, None)], "id int, text string")
    phrases = [f"w{i} w{(i * i) % 23}" for i in range(23)] + ["w1 w2 w4", "w4", "#w1 W2", "nowhere w1", " "]
    table = spark.createDataFrame([(p,) for p in [*phrases, None]], "phrase string")
    found = match.tracked_phrases(df, table, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[:plan.index("BroadcastHashJoin")]
    assert "Exchange" not in below and "SortMergeJoin" not in plan
    want = sorted(map(tuple, found.collect()), key=repr)
    texts = {}
    for key, t in [(r["id"], r["text"]) for r in df.collect()]:
        texts.setdefault(key, []).append({f for w in (t or "").lower().split() for f in (w, w.lstrip("#@"))})
    hold = lambda term: sum(term in f for fs in texts.values() for f in fs)
    hand = []
    for p in {p for p in phrases if p.split()}:
        terms = sorted(set(p.lower().split()))
        for key, fs in texts.items():
            if all(any(t in f for f in fs) for t in terms):
                hand.append((key, p, {sum(t in f for f in fs) for t in terms if hold(t) == min(map(hold, terms))}))
    assert {(k, p) for k, p in want} == {(k, p) for k, p, _ in hand}
    assert all(want.count((k, p)) in n for k, p, n in hand)
    monkeypatch.setattr(match, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, match.tracked_phrases(df, table, "id").collect()), key=repr) == want
    monkeypatch.undo()
    monkeypatch.setattr(match, "TASK_MEETINGS", 10)
    assert sorted(map(tuple, match.tracked_phrases(df, table, "id").collect()), key=repr) == want
