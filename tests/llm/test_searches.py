import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from civicpulse.llm import negatives, queries, shards, topk

FOLDER = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def whole(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def dot(a, b):
    return int(sum(x * y for x, y in zip(a, b)))


def brute_topk(rows, k):
    rows = [r for r in rows if r[0] is not None and whole(r[1])]
    out = []
    for q, v in {(i, tuple(v)) for i, v, asks in rows if asks}:
        near = sorted((-dot(v, w), i) for i, w, _ in rows if i != q and len(w) == len(v))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(out)


def brute_negatives(rows, positives, count, low, high):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and whole(r[1])]
    out = []
    for a, v, label in {(i, tuple(v), l) for i, v, l, asks in rows if asks}:
        scored = sorted((-dot(v, w), i, l) for i, w, l, _ in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:count]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed, n, dim, spread=40):
    draw = np.random.default_rng(seed)
    x = np.floor(draw.normal(size=(n, dim)) * spread * draw.random(n)[:, None])
    x[draw.integers(0, n, n // 8)] = x[0]
    return [(int(i), [float(c) for c in v], str(l), bool(a)) for i, v, l, a in zip(
        draw.permutation(n), x, draw.integers(0, 3, n), draw.random(n) < .3)]


ODD = [(None, [1.0, 2.0], "1", True), (1000, None, "1", True), (1001, [], "1", True), (1002, [1.0, None], "1", True),
       (1003, [NAN, 1.0], "1", True), (1004, [INF, 1.0], "1", True), (1005, [3.0, -1.0], None, True), (1006, [3.0, -1.0], "1", None),
       (1007, [0.0, 0.0], "0", True), (1008, [2.0, 2.0], "0", True), (1008, [2.0, 2.0], "0", True), (1009, [1.0, 1.0], "2", False),
       (1009, [1.0, 1.0], "2", False), (1010, [1.0], "2", True), (1011, [-5.0, -4.0], "0", True), (1012, [1.0, 2.0], "9", True)]
SCHEMA = "vec_id long, vector array<double>, label string, asks boolean, key int, shard string, rank int, least string"


def frame(spark, rows, *names):
    full = spark.createDataFrame([(*r, 0, "s", 0, "x") for r in rows], SCHEMA)
    return full.withColumnRenamed("asks", *names)


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "SHARD_ROWS", (16, 50))
    monkeypatch.setattr(topk, "BLOCK_ROWS", (4, 20))
    rows = vectors(seed, 160, 6) + ODD
    got = topk.top_k(frame(spark, rows, "is_query"), k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_topk([(i, v, a) for i, v, _, a in rows], 4)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "SHARD_ROWS", (16, 60))
    monkeypatch.setattr(negatives, "BLOCK_ROWS", (4, 20))
    rows = vectors(seed, 150, 12) + ODD
    got = negatives.hard_negatives(frame(spark, rows, "is_anchor"), positives=3, negatives=4)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 3, 4, 30, 90)


def test_empty(spark):
    none = frame(spark, ODD[:2], "is_query").limit(0)
    assert topk.top_k(none).count() == 0
    assert negatives.hard_negatives(none.withColumnRenamed("is_query", "is_anchor")).count() == 0
    quiet = frame(spark, [(1, [1.0], "a", False), (2, [1.0], "b", None)], "is_query")
    assert topk.top_k(quiet).count() == 0
    assert negatives.hard_negatives(quiet.withColumnRenamed("is_query", "is_anchor")).count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_threshold_algorithm_stops_early_and_right(seed):
    draw = np.random.default_rng(seed)
    n, d = 3000, 5
    x = np.floor(draw.normal(size=(n, d)) * 50)
    ids = draw.permutation(n).astype(np.int64)
    lists = topk.Lists(ids, x)
    q = np.floor(draw.normal(size=d) * 50) if seed else np.zeros(d)
    near, scores, scored = lists.top(q, 7, 5)
    want = sorted((-s, i) for s, i in zip((x @ q).tolist(), ids.tolist()) if i != 7)[:5]
    assert list(zip((-scores).tolist(), near.tolist())) == want
    assert scored < n / 2 or not seed
    least = float(scores[2])
    some = lists.top(q, 7, 5, least)
    assert some[0].tolist() == [i for s, i in want if -s >= least] and some[2] <= scored


@pytest.mark.parametrize("seed", range(10))
def test_threshold_join(seed):
    draw = np.random.default_rng(seed)
    n, d = 700, 37
    x = np.floor(draw.normal(size=(n, d)) * np.linspace(60, 1, d)[draw.permutation(d)])
    q = np.floor(draw.normal(size=(9, d)) * 30)
    q[3] = 0
    index = negatives.Index(x, np.argsort(-(x ** 2).sum(axis=0)))
    scores = q @ x.T
    least = np.quantile(scores, .5 + .05 * np.arange(9) * .99, axis=1).diagonal() if seed else np.full(9, -np.inf)
    found = {place: dict(zip(rows.tolist(), s.tolist())) for place, rows, s in index.above(q, least)}
    assert found == {i: {j: scores[i, j] for j in np.nonzero(scores[i] >= least[i])[0].tolist()} for i in range(9)}


def test_index_leaves_out_what_norms_cover():
    x = np.random.default_rng(1).normal(size=(500, 64)) * np.geomspace(1, .01, 64)
    index = negatives.Index(x, np.arange(64))
    rows, sizes = index.lists(1.0)
    assert sizes[-1] == 0 and (np.diff(sizes) <= 0).all() and sizes[0] > 0
    assert (index.suffix[rows[:sizes[1]], 1] >= 1.0).all() and (index.suffix[rows[sizes[1]:], 1] < 1.0).all()


@pytest.mark.parametrize("name", ["op11_negatives", "op13_topk"])
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_queries_equal_sql(spark, name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = con.sql(queries.SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) != []


def test_integers(spark):
    row = spark.sql("SELECT array(float(0.1), float(-0.1), null) AS v").select(shards.integers(F.col("v")).alias("w")).first()
    assert row["w"] == [25.0, -26.0, None]
