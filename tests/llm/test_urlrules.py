import re

from civicpulse.llm import urlrules
from civicpulse.llm.queries import SQL, URL_RULES, op9_urls
from civicpulse.llm.urlrules import judged
from tests.check import canonical, connect


def plain(url, rules, default="allow"):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[2]), m[3]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [None, "", "http://", "x", "://net/", "http://NET/", "http://a.net", "http://a.net/x?y#z", "https://example.net/en/",
        "http://m.example.net/en", "http://example.com/de/7?q=://b.net/", "http://org/fr/", "http://xorg/fr/", "http://.net/",
        "http://a..net/é/\n/b", "http://example.org:80/fr/1", "ftp://u@b.EXAMPLE.org/fr/1#t", "http://net/" + "x/" * 5000,
        "http://" + "a." * 400 + "net/", "http://a.net/"]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    df = op9_urls(spark, folder)
    relation = connect(folder).sql(SQL["op9_urls"])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(relation.columns, relation.fetchall())


def test_rules(spark, monkeypatch):
    rules = [*URL_RULES, ("com", "/d", "allow"), ("net", "", "block"), ("a.net", "/x", "allow"), ("net", "/", "block")]
    pages = spark.createDataFrame([(i % 17 or None, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    want = sorted(((i % 17 or None, *plain(u, rules)) for i, u in enumerate(URLS)), key=repr)
    for few in (1000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(urlrules, "FEW_RULES", few)
        assert sorted((tuple(r) for r in judged(pages, table).collect()), key=repr) == want
    assert judged(pages.limit(0), table).count() == 0
    assert judged(pages, table.limit(0)).where("rule IS NULL AND verdict = 'allow'").count() == len(URLS)
