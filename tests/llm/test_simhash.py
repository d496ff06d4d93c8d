import random

import numpy as np
import xxhash

from civicpulse.llm.common import Store
from civicpulse.llm.components import components
from civicpulse.llm.queries import op2_simhash
from civicpulse.llm.simhash import fingerprint, near_duplicates, near_edges


def plain_fingerprint(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, shingle=3, distance=2):
    prints = {}
    for key, text in rows:
        prints.setdefault(plain_fingerprint(text or "", shingle), []).append(key)
    keys = list(prints)
    values = np.array(keys, np.uint64)
    links = [(prints[keys[i]][0], prints[keys[j]][0]) for i in range(len(keys))
             for j in np.nonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance)[0] + i + 1]
    links += [(ids[0], other) for ids in prints.values() for other in ids[1:]]
    return groups(links, [k for k, _ in rows])


def test_fingerprints():
    for text in ["", " \t", "A", "a b", "A b C d é\xa0É", "x\x1cy z w v", "the cat " * 500]:
        for size in (1, 3, 5):
            assert fingerprint(text.encode(), size) % 2**64 == plain_fingerprint(text, size)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = op2_simhash(spark, folder).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(t, 3) for r, (k, t) in zip(
        sorted(got), sorted(rows)))


def test_near_edges_lose_nothing(spark):
    draw = random.Random(3)
    values = {0, 2**64 - 1}
    for _ in range(60):  # clouds of fingerprints, one of them large
        middle = draw.getrandbits(64)
        for _ in range(400 if not draw.randrange(20) else 6):
            values.add(middle ^ sum({1 << draw.randrange(64 if draw.random() < .3 else 12) for _ in range(draw.randrange(5))}))
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    array = np.array(values, np.uint64)
    for distance in (1, 2):
        links = [(i, j) for i in range(len(values))
                 for j in (np.nonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= distance)[0] + i + 1).tolist()]
        edges = near_edges(spark.createDataFrame(signed, "fp long, rep long"), distance)
        got = [tuple(r) for r in edges.collect()]
        assert all(int(values[a] ^ values[b]).bit_count() <= distance for a, b in got)
        assert groups(got, range(len(values))) == groups(links, range(len(values)))


def test_components(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)]
    links += [(draw.randrange(2000, 2400), draw.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000), (7, 3)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame, Store(spark, "t")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == groups([x for x in links if x[0] != x[1]], nodes)
    assert components(frame.limit(0), Store(spark, "t")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b c d", 5), (4, "A b\tc d", 5), (4, "A b c d", 5), (None, "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, fp int")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == [(0, 4), (0, None), (1, 1), (2, 1), (4, 4), (4, 4)]
    assert near_duplicates(docs.limit(0)).count() == 0
    hot = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one two three four', 'w' || id) AS text")
    assert near_duplicates(hot).where("doc_id % 3 = 0 AND component_id = 0").count() == 6667
