from pyspark.sql import functions as F

from civicpulse.functions import urls
from civicpulse.sources.buckets import Buckets
from civicpulse.operators import links
from civicpulse.schemas import EDGE, PAGE

BASE = "http://www.tripadvisor.com"
LIST = """<link rel="next" href="/p2.html"><div class="navLinks"><a href="/h.html">Hotels</a><a href="f.html"><b>For</b>um</a></div>
<div class="a result GEOS"><div onclick="http://www.tripadvisor.com/x/T-g1.html','y">Go</div></div><div class="result">
<div onclick="/no"></div></div><ul class="accommodation_type"><a href="/b.html">B</a></ul>
<div class="property_title"><a href="/h.html">Hotels</a><a href="/h.html">Other text</a></div>
<table class="x topics"><tr><td><b><a href="/no1">n</a></b></td><td><b><a href="/t1">T</a></b></td></tr></table>
<div class="pgLinks"><a href="/t?p=2">2</a></div><a href="/no2">no</a>"""
INDEX = """<table><tr><td>x</td><td class="alt1 y"><a href="f1">F1</a></td><td><div><a href="t1">T1</a></div></td></tr></table>
<a rel="next" href="?page=2">&gt;</a><a href="/no">no</a>"""


def table(spark, *rows):
    return spark.createDataFrame(rows, PAGE)


def test_review_site_rules(spark):
    got = links.requests(table(spark, (BASE + "/d/p1", LIST, "rome"), (BASE + "/img", None, "rome")), links.REVIEW_RULES)
    rows = {(r.rule, r.link, r.link_text) for r in got.collect()}
    assert rows == {
        (0, BASE + "/h.html", "Hotels"), (0, BASE + "/d/f.html", "Forum"), (1, BASE + "/p2.html", ""),
        (2, BASE + "/T-g1.html", "Go"), (3, BASE + "/b.html", "B"), (4, BASE + "/h.html", "Other text"),
        (5, BASE + "/t1", "T"), (6, BASE + "/t?p=2", "2")}
    assert {(r.url, r.city) for r in got.collect()} == {(BASE + "/d/p1", "rome")}


def test_forum_rules(spark):
    got = links.page_links(table(spark, ("http://f.org/i", INDEX, None)), links.FORUM_RULES)
    assert {(r.rule, r.link) for r in got.collect()} == {
        (0, "http://f.org/f1"), (1, "http://f.org/i?page=2"), (2, "http://f.org/t1")}


def test_user_functions_of_a_rule(spark):
    rules = (
        links.Rule("menu", links.by_class("navLinks"), process_value=str.upper,
                   process_links=lambda df: df.where("link_text <> 'Forum'"),
                   callback=lambda pages: pages.select("url", "city", F.length("html").alias("size"))),
        links.Rule("more", links.by_class("pgLinks")))
    pages = table(spark, (BASE + "/d", LIST, "rome"), (BASE + "/H.HTML", "abc", None))
    found = links.requests(pages, rules, process_request=lambda df: df.withColumn("priority", F.lit(1)))
    assert {(r.rule, r.link, r.priority) for r in found.collect()} == {
        (0, BASE + "/H.HTML", 1), (1, BASE + "/t?p=2", 1)}
    called = links.run_callbacks(found, pages, rules)
    assert [tuple(r) for r in called["menu"].collect()] == [(BASE + "/H.HTML", "rome", 3)]


def test_links_in_comparable_form():
    form = lambda value: links.followable("http://A.org/d/p", value)
    assert form(" q.html#top ") == "http://a.org/d/q.html"
    assert form("/x?b=2&a=1&c=") == "http://a.org/x?a=1&b=2&c="
    assert form("https://B.org") == "https://b.org/"
    assert [form(v) for v in ("javascript:go()", "mailto:a@b", "/pic.JPG", "http://[bad")] == [None] * 4


def test_base_element_and_dropped_values(spark):
    html = '<base href="http://b.org/r/"><div class="m"><a href="x">X</a><a href="y">Y</a></div>'
    rules = (links.Rule("m", links.by_class("m"), process_value=lambda v: None if v == "y" else v),)
    got = links.page_links(table(spark, ("http://a.org/", html, None)), rules).collect()
    assert [(r.link, r.link_text) for r in got] == [("http://b.org/r/x", "X")]


def test_first_seen_is_idempotent(spark):
    df = spark.createDataFrame([(5, "a?x"), (1, "a"), (2, "b#y"), (3, "b"), (4, "c")], "n int, url string")
    plain = links.first_seen(df, "n")
    assert plain.count() == 5
    once = links.first_seen(df, "n", normalize=urls.without_query)
    assert sorted(r.n for r in once.collect()) == [1, 2, 4]
    twice = links.first_seen(once, "n", normalize=urls.without_query)
    assert sorted(r.n for r in twice.collect()) == [1, 2, 4]
    copies = df.union(spark.createDataFrame([(9, "c")], "n int, url string"))
    assert sorted(r.n for r in links.first_seen(copies, "n").collect()) == [1, 2, 3, 4, 5]


def test_unseen_and_domains(spark):
    df = spark.createDataFrame([("http://a.org/1",), ("http://x.a.org/2",), ("http://b.org/3",)], "url string")
    assert links.unseen(df, df.limit(1)).count() == 2
    assert {r.url for r in links.in_domains(df, ["a.org"]).collect()} == {"http://a.org/1", "http://x.a.org/2"}


def reach(seeds, edges):
    """Round by round in plain Python."""
    seen, frontier, depth = {}, dict(seeds), 0
    while frontier:
        seen.update({u: (c, depth) for u, c in frontier.items()})
        step = {}
        for src, dst in edges:
            if src in frontier and dst not in seen:
                step[dst] = min(step.get(dst, frontier[src]), frontier[src])
        frontier, depth = step, depth + 1
    return seen


def test_city_lineage(spark):
    edges = [("s1", "a"), ("s2", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("s2", "c"), ("z", "y"), ("c", "d"), ("s1", "s2")]
    edges += [(f"n{i}", f"n{(i * 3 + k) % 60}") for i in range(60) for k in (1, 2)] + [("d", "n7")]
    seeds = [("s1", "rome"), ("s2", "oslo")]
    frame = spark.createDataFrame(edges, EDGE)
    start = spark.createDataFrame(seeds, "url string, city string")
    got = {r.url: (r.city, r.depth) for r in links.propagate_cities(start, frame).collect()}
    assert got == reach(dict(seeds), edges)
    short = links.propagate_cities(start, frame, max_depth=1).collect()
    assert {r.url for r in short} == {"s1", "s2", "a", "c"}


def plan_tree(df):
    """Per node of the executed plan its depth and text, parents first."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [(len(x) - len(x.lstrip(" :+-*(0123456789)")), x) for x in lines if x.strip()]


def test_a_round_moves_the_frontier_alone(spark, tmp_path):
    edges = spark.range(4000).selectExpr("'p' || id % 500 AS src", "'q' || id AS dst").unionByName(
        spark.range(500).selectExpr("'hub' AS src", "'p' || id AS dst"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held, hot = links.link_buckets(edges, str(tmp_path / "links"))
        visited = Buckets(spark, str(tmp_path / "visited"), ("url",), "depth")
        visited.append(spark.createDataFrame([("hub", "rome", 0)], "url string, city string, depth int"))
        step = links.next_reached(held.read(), hot, visited.read(), 1)
        tree = plan_tree(step)
        scans = [i for i, (_, x) in enumerate(tree) if "FileScan" in x and "Bucketed: true" in x]
        assert any("dst" in tree[i][1] for i in scans)
        for i in scans:
            above, depth = [], tree[i][0]
            for at in range(i - 1, -1, -1):
                if tree[at][0] < depth:
                    depth = tree[at][0]
                    above.append(tree[at][1])
            # Between the scan of bucketed links or urls and its join nothing is shuffled.
            joined = next(k for k, x in enumerate(above) if "Join" in x)
            if "PartitionFilters: [isnotnull(depth" not in tree[i][1]:
                assert not any("Exchange" in x for x in above[:joined]), tree[i][1]
        assert step.count() == 500
        visited.append(step)
        assert links.next_reached(held.read(), hot, visited.read(), 2).count() == 4000
        assert {r["depth"] for r in visited.close().select("depth").distinct().collect()} == {0, 1}
        held.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lineage_of_a_page_with_most_links(spark):
    edges = [("s", f"a{i}") for i in range(50)] + [(f"a{i}", "b") for i in range(50)]
    got = links.propagate_cities(spark.createDataFrame([("s", "rome")], "url string, city string"),
                                 spark.createDataFrame(edges, EDGE))
    assert sorted({(r.city, r.depth) for r in got.collect()}) == [("rome", 0), ("rome", 1), ("rome", 2)]
    assert got.count() == 52


def test_seeds_come_from_search_urls(spark):
    df = spark.createDataFrame([(BASE + "/Search?q=new+york+city",), (BASE + "/Hotels",)], "url string")
    assert [tuple(r) for r in links.seed_cities(df).collect()] == [(BASE + "/Search?q=new+york+city", "new york city")]


def test_cities_reach_beyond_any_depth(spark):
    chain = spark.range(30).selectExpr("'p' || id AS src", "'p' || (id + 1) AS dst")
    seeds = spark.createDataFrame([("p0", "rome"), ("p20", "bonn")], "url string, city string")
    got = {r["url"]: (r["city"], r["depth"]) for r in links.propagate_cities(seeds, chain).collect()}
    assert len(got) == 31 and got["p19"] == ("rome", 19) and got["p30"] == ("bonn", 10)


def test_distinct_links_are_found_once(spark, tmp_path, monkeypatch):
    """Links are made distinct in one pass: how many a page has and its buckets come from the stored ones."""
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    seen = spark.sparkContext.accumulator(0)
    rows = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "b"), (None, "a"), ("c", None)] + [("hub", f"p{i}") for i in range(200)]

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(rows, "src string, dst string").mapInArrow(noted, "src string, dst string")
    held, hot = links.link_buckets(edges, str(tmp_path / "links"))
    assert seen.value == len(rows)
    assert sorted({(r.src, r.dst) for r in held.read().collect()})[:2] == [("a", "b"), ("a", "c")] and held.read().count() == 202
    assert {p.name for p in tmp_path.iterdir()} == {"links", "checkpoints"}
    held.close()
