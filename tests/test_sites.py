import random

from civicpulse.functions.markup import parse
from civicpulse.operators import links, sites

BODY = '<div class="post"><div class="location">L{0}</div><div class="postBody"><p>text {0}</p></div></div>'
RULES = (
    links.Rule("menu", links.by_class("menu")),
    links.Rule("talk", links.by_class("talk"), layout="thread"),
    links.Rule("odd", links.by_class("menu", "odd"), layout="thread"),
)
SITE = sites.Site(RULES, ("a.org",))


def page(i, menu=(), talk=(), odd=()):
    links_of = lambda name, found: f'<div class="{name}">' + "".join(f'<a href="{x}">{x}</a>' for x in found) + "</div>"
    return links_of("menu", menu) + links_of("talk", talk) + links_of("menu odd", odd) + BODY.format(i)


def plain(start, pages, rules, domain):
    """The worklist in plain Python: requests and the pages read for threads."""
    rows = links.link_rows(rules)
    seen, frontier, depth, read = {}, dict(start), 0, []
    frontier = {u: (c, -1) for u, c in start}
    while frontier:
        seen.update({u: (c, r, depth) for u, (c, r) in frontier.items()})
        found = {}
        for url, (city, rule) in frontier.items():
            if url not in pages:
                continue
            root = parse(pages[url])
            if rule >= 0 and rules[rule].layout == "thread":
                read.append((url, city))
            first = {}
            for _, _, index, link, _ in rows(url, city, root):
                first[link] = min(first.get(link, index), index)
            for link, index in first.items():
                if domain in link.split("/")[2]:
                    found.setdefault(link, []).append((city, index))
        frontier, depth = {u: min(x) for u, x in found.items() if u not in seen}, depth + 1
    return seen, sorted(read)


def test_worklist_equals_plain_python(spark):
    draw = random.Random(11)
    url = lambda i: f"http://a.org/{i}.html"
    some = lambda: [url(draw.randrange(45)) for _ in range(draw.randrange(3))]
    pages = {url(i): page(i, some(), some(), some()) for i in range(40)}
    pages[url(3)] += '<div class="menu"><a href="http://b.org/1.html">b</a><a href="http://x.a.org/1.html">x</a></div>'
    pages["http://b.org/1.html"], pages["http://x.a.org/1.html"] = page("b"), page("xa")
    start = [(url(3), "rome"), (url(5), "oslo"), (url(99), "nice")]
    stored = spark.createDataFrame([*pages.items(), *list(pages.items())[:4]], "url string, html string")
    items, requests = sites.crawled(spark.createDataFrame(start, "url string, city string"), stored, SITE)
    want, read = plain(start, pages, RULES, "a.org")
    assert {r["url"]: (r["city"], r["rule"], r["depth"]) for r in requests.collect()} == want and requests.count() == len(want)
    assert sorted((r["url"], r["city"]) for r in items.where("position = 0").collect()) == read and len(read) > 5
    assert max(d for _, _, d in want.values()) > 3


def test_hooks_depth_and_empty_store(spark):
    pages = spark.createDataFrame([("http://a.org/0", page(0, ["/1", "/2"])), ("http://a.org/1", page(1, ["/3"])), ("http://a.org/2", None),
                                   (None, "x"), ("http://a.org/3", page(3, talk=["/4"])), ("http://a.org/4", page(4))], "url string, html string")
    start = spark.createDataFrame([("http://a.org/0", None)], "url string, city string")
    _, requests = sites.crawled(start, pages, SITE, max_depth=1)
    assert sorted(r["url"][-1] for r in requests.collect()) == ["0", "1", "2"]
    fewer = (links.Rule("menu", links.by_class("menu"), process_links=lambda df: df.where("link NOT LIKE '%/1'")), *RULES[1:])
    _, requests = sites.crawled(start, pages, sites.Site(fewer, ("a.org",)))
    assert sorted(r["url"][-1] for r in requests.collect()) == ["0", "2"]
    items, requests = sites.crawled(start, pages, SITE)
    assert [(r["url"][-1], r["layout"], r["text"] is not None) for r in items.collect()] == [("4", "thread", True)]
    items, requests = sites.crawled(start, pages.limit(0), SITE)
    assert items.count() == 0 and requests.count() == 1
