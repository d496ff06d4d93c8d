import random

import corpus_pipeline
from civicpulse.llm import nearcopies

from .test_dedup import split_words
from .test_simhash import groups


def brute_copies(rows, size=5, least=0.8):
    """rows: (key, text); the least key of each row's group"""
    sets, holders, links = {}, {}, []
    for key, text in rows:
        words = split_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        n = min(size, len(words))
        sets[key] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()
        for x in sets[key] or {()}:
            holders.setdefault(x, []).append(key)
    pairs = {(a, b) for keys in holders.values() for i, a in enumerate(keys) for b in keys[i + 1:]}
    for a, b in pairs:
        both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if not every or both >= least * every - 1e-9:
            links.append((a, b))
    return groups(links, [k for k, _ in rows])


def copies(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [[draw.choice(words) for _ in range(draw.randrange(1, 120))] for _ in range(40)]
    out = []
    for text in texts:
        for _ in range(draw.randrange(1, 12)):
            text = list(text) if draw.random() < .7 else out[draw.randrange(len(out))][:] if out else list(text)
            for _ in range(draw.randrange(3)):
                text[draw.randrange(len(text))] = draw.choice(words)
            out.append(text)
    return [" ".join(x) for x in out] + ["", " \n", "W1 w2", "w1\tW2"]


def test_near_dedup_stage_links_all_similar_texts(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(copies(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_copies([r[:2] for r in rows])
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))
    assert nearcopies.representatives(docs.limit(0)).count() == 0


def test_near_dedup_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_copies([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(want.values())


def test_rows_are_judged_one_by_one(spark):
    rows = [(1, "a b c d e f"), (3, "A b c d e f"), (3, "u v w x y z"), (None, "a b c d e f"), (5, "k l m"), (5, "k l m"),
            (None, "q r s t u"), (None, "q r s t u"), (None, "Q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"].lower()) for r in nearcopies.representatives(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a b c d e f"), (3, "u v w x y z"), (5, "k l m"), (None, "q r s t u")], key=repr)


def test_odd_columns_and_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, long, {"a": 1}, "s"), (2, long + " more", {}, "t"), (2, long + " more", {"z": 0}, "t"), (3, None, None, None), (4, "", {}, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>, node string")
    got = nearcopies.representatives(docs).collect()
    assert nearcopies.representatives(docs).columns == docs.columns
    assert sorted((r["doc_id"], r["node"]) for r in got) == [(1, "s"), (3, None)]
    alone = nearcopies.representatives(docs.where("doc_id = 2")).collect()
    assert [r["a.b"] for r in alone] == [{"z": 0}]


def passages(seed, n, shared, lines, own):
    """Documents of some out of a few shared lines of 25 words and some lines of their own."""
    draw = random.Random(seed)
    line = lambda: " ".join(f"v{draw.randrange(10_000)}" for _ in range(25))
    common = [line() for _ in range(lines)]
    return [(i, "\n".join([*draw.sample(common, shared), *(line() for _ in range(own))])) for i in range(n)]


def test_shared_lines_do_not_make_pairs_of_all(spark, monkeypatch):
    compared = []
    similar = nearcopies.similar

    def counting(pairs, *rest):
        compared[-1] += pairs.count()
        return similar(pairs, *rest)

    def representatives(rows):
        compared.append(0)
        return {r["doc_id"] for r in nearcopies.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    monkeypatch.setattr(nearcopies, "similar", counting)
    mixed = passages(4, 300, 6, 40, 2)
    assert representatives(mixed) == set(brute_copies(mixed).values())
    # One line that all share: what is compared stays far below the number of documents.
    for n in (500, 4000):
        assert len(representatives(passages(4, n, 1, 1, 3))) == n
    assert compared[0] < 300 and compared[1] <= 50 and compared[2] <= 400


def edited(seed, n, words, edits):
    """Copies of one text, each with words of its own in some places."""
    draw = random.Random(seed)
    text = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(text)
        for at in draw.sample(range(words), draw.randrange(*edits)):
            copy[at] = f"e{i}x{at}" if draw.random() < .7 else f"z{draw.randrange(9)}"
        out.append((i, " ".join(copy)))
    return out


def test_copies_with_different_edits_are_not_compared_all_with_all(spark, monkeypatch):
    compared = []
    similar = nearcopies.similar

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(nearcopies, "similar", counting)
    rows = edited(3, 400, 150, (2, 8))
    got = nearcopies.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(brute_copies(rows).values())
    assert sum(compared) < 5 * len(rows)


def test_texts_that_simhash_finds_are_compared(spark, monkeypatch):
    # Without a band in common only the fingerprints bring copies together.
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h a b c d e f g h"), (3, "q r s t u v w x")]
    monkeypatch.setattr(nearcopies, "bands", lambda x, *_: x[:0].view("int64"))
    monkeypatch.setattr(nearcopies, "fingerprint", lambda text, words: 8 * (b"q" in text))
    docs = spark.createDataFrame([*rows, (4, "a b c d e f g h i")], "doc_id long, text string")
    assert {r["doc_id"] for r in nearcopies.representatives(docs).collect()} == {1, 2, 3}


def test_only_copies_that_can_be_similar_meet_in_a_star(spark, tmp_path):
    # Of the 180,000 pairs of copies few are similar; all of these have to meet, and hardly any other.
    known = nearcopies.Hashes(22)
    sets = [nearcopies.shingles(text.encode(), 5, known) for _, text in edited(8, 600, 150, (1, 9))]
    center, least = min(range(600), key=lambda i: len(set(sets[i].tolist()) - set(sets[0].tolist()))) or 1, 0.8
    linked = {i for i in range(600) if i == center or nearcopies.alike(sets[center], sets[i], least)}
    rows = [(7, i, len(x), -1 if i in linked else i, [int(v) for v in nearcopies.np.setxor1d(sets[center], x).view("int64")])
            for i, x in enumerate(sets) if i != center]
    stars = spark.createDataFrame(rows, "a long, b long, size int, component long, apart array<long>")
    got = {tuple(r) for r in nearcopies.crossing(stars, least, nearcopies.Store(spark, "star")).collect()}
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if center not in (i, j)
            and not (i in linked and j in linked) and nearcopies.alike(sets[i], sets[j], least)}
    assert 0 < len(linked) < 600 and want and want <= got
    assert len(got) < 10 * len(want) + 600
