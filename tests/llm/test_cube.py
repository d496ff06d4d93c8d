import random
import re

from civicpulse.llm.cube import flight, landing, mix_documents, mixed
from civicpulse.llm.queries import op7_cube


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (left - sum(most * sizes[s] for s in full)) / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def check(rows, texts):
    """rows: (doc_id, size, source_size, target, taken, source)"""
    sizes = {}
    for source, text in texts:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6, (source, taken[source], want[source])


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [tuple(r) for r in docs.select("source", "text").collect()]
    rows = op7_cube(spark, folder).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert sorted(rows) == sorted(op7_cube(spark, folder).collect())


def test_flight_keeps_totals():
    draw = random.Random(1)
    for n in (0, 1, 2, 3, 50, 900):
        sizes = [draw.randrange(0, 40) for _ in range(n)]
        chances = [draw.choice([0.0, 1.0, .3, .5, .77]) for _ in range(n)]
        out = flight(sizes, chances, draw)
        assert sum(0 < c < 1 for c in out) <= 2 and all(0 <= c <= 1 for c in out)
        assert abs(sum(out) - sum(chances)) < 1e-6
        assert abs(sum(s * c for s, c in zip(sizes, out)) - sum(s * c for s, c in zip(sizes, chances))) < 1e-6
        assert set(landing(sizes, out)) <= {0, 1}
    means = [0.0] * 4
    for seed in range(3000):
        for i, c in enumerate(flight([3, 3, 5, 7], [.5, .5, .5, .5], random.Random(seed))):
            means[i] += c / 3000
    assert all(.46 < m < .54 for m in means)


def test_large_source_in_blocks_and_odd_rows(spark):
    many = spark.range(9000).selectExpr(
        "id AS doc_id", "repeat('w ', int(id % 37)) AS text", "if(id % 3 = 0, 'big', string(id % 5)) AS source", "1 AS size")
    odd = spark.createDataFrame(
        [(None, None, None, 1)] * 3 + [(5, "a b", None, 2)] * 2500 + [(None, "", "é", 3)], "doc_id long, text string, source string, size int")
    docs = many.unionByName(odd)
    rows = mixed(docs).collect()
    assert len(rows) == docs.count()
    check(rows, [tuple(r) for r in docs.select("source", "text").collect()])
    assert mixed(docs.limit(0)).count() == 0
    mix = mix_documents(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r["copies"] for r in rows)
