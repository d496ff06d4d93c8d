from datetime import datetime

from pyspark.sql import functions as F

from civicpulse.functions.markup import own_texts, parse
from civicpulse.operators import pages
from civicpulse.plans import posts
from civicpulse.schemas import PAGE

POST = """<table id="post{i}"><tr><td class="thead x"><div><span><span><b>{when}</b></span></span></div></td></tr>
<tr><td class="alt2"><table><tr><td valign="top"><div><div>Join</div><div>Posts: 3
{place}</div></div></td></tr></table></td>
<td class="alt1"><div id="post_message_{i}">Hello<br>\n\tthere <b>bold</b> &amp; <i>more</i>end</div></td></tr></table>"""
FORUM = """<html><body><table><tr><td class="alt1"><table><tr><td class="navbar x"><strong>
 {topic} </strong></td></tr></table></td></tr></table>{posts}</body></html>"""


def page_table(spark, *rows):
    return spark.createDataFrame(rows, PAGE)


def forum(topic, *posts):
    return FORUM.format(topic=topic, posts="".join(POST.format(i=i, when=w, place=p) for i, (w, p) in enumerate(posts)))


def test_forum_posts(spark):
    html = forum("New York City | Towers", ("Today, 1:05 PM", "Location: Oak Park, IL"),
                 ("Yesterday, 2:00 AM", "no place"), ("Mar 7, 2015, 9:30 AM", ""), ("nonsense", "Location: X"))
    table = page_table(spark, ("u1", html, None), ("u2", forum("old boston", ("Today, 1:05 PM", "")), None),
                       ("u3", "<p>post_message_</p>", None), ("u4", None, None))
    got = pages.forum_items(table, ["new york", "New York City", "boston"], F.lit("2015-03-10").cast("timestamp"))
    rows = sorted(got.collect(), key=lambda r: (r.city, r.position))
    assert [r.city for r in rows] == ["New York City"] * 4 + ["new york"] * 4
    assert {r.text for r in rows} == {"Hello there & end"}
    assert [r.geo for r in rows[:4]] == ["Oak Park, IL", None, None, "X"]
    assert [r.date for r in rows[:4]] == [datetime(2015, 3, 10, 13, 5), datetime(2015, 3, 9, 2), datetime(2015, 3, 7, 9, 30), None]
    assert pages.undated(got).count() == 2


REVIEWS = """<div id="expanded_review_1"><span class="noQuotes">Nice
 one</span><div class="location">Paris, France</div><span class="ratingDate relative" title="April 2, 2014">x</span>
 <div class="entry"><p>First<b>bold</b></p><p>second\n line</p></div></div>
<div id="expanded_review_2"><span class="ratingDate">Reviewed May 12, 2013 </span><div class="entry"><p>third</div></div>
<div id="expanded_review_3"><span class="ratingDate">Reviewed lately</span><div class="entry"><p>dropped</p></div></div>
<div id="other"><div class="entry"><p>no</p></div></div>"""


def test_reviews(spark):
    got = pages.review_items(page_table(spark, ("u", REVIEWS, "boston"))).orderBy("position").collect()
    assert [(r.city, r.title, r.text, r.geo, r.date) for r in got] == [
        ("boston", "Nice one", "First second line", "Paris, France", datetime(2014, 4, 2)),
        ("boston", None, "third", None, datetime(2013, 5, 12)),
        ("boston", None, "dropped", None, None)]  # by the dated items, not here
    assert pages.dated(got_frame(spark)).count() == 2
    assert [r.date_text for r in posts.undated_reviews(page_table(spark, ("u", REVIEWS, "boston"))).collect()] == ["Reviewed lately"]


def got_frame(spark):
    return pages.review_items(page_table(spark, ("u", REVIEWS, "boston")))


THREAD = """<h1 id="HEADING">\nBest food?\n</h1>
<div class="post a"><div class="postDate"><span>Jan 3, 2016, 7:05 PM</span></div><div class="location">Rome</div>
<div class="postBody"><p>Line one
two</p><p><i>x</i>y &lt;3 &amp;</p></div></div>
<div class="post"><div class="postDate">bad date</div><div class="postBody">z</div></div>
<div class="postcard"><div class="postBody">no</div></div>"""


def test_threads(spark):
    got = pages.thread_items(page_table(spark, ("u", THREAD, "rome"))).orderBy("position").collect()
    assert [(r.title, r.text, r.geo, r.date) for r in got] == [
        ("Best food?", "Line onetwoxy &lt;3 &amp;", "Rome", datetime(2016, 1, 3, 19, 5)), ("Best food?", "z", None, None)]


def test_detail_requests_need_ids_and_a_property_url(spark):
    html = '<div id="review_11" class="a reviewSelector"></div><div class="reviewSelector" id="review_12"></div><i id="review_9">'
    good = "http://www.tripadvisor.com/Hotel_Review-g1-d2-Reviews-Inn.html"
    got = pages.detail_requests(page_table(
        spark, (good, html, "rome"), (good, "<p>none</p>", "rome"), ("http://x.org/", html, "rome"))).collect()
    assert [(r.city, r.page_url) for r in got] == [("rome", good)]
    assert "target=11&context=1&reviews=11,12&" in got[0].url


def test_tree_tolerates_broken_markup():
    root = parse("<p>a<p>b<br>c</i><ul><li>1<li>2<ul><li>2.1</ul></ul><!-- <p>x --><script>if (a<b) '</p>'</script>3 < 4 <x y='>'>t")
    assert [own_texts(p) for p in root.findall("p")][0] == ["a"]
    assert len(list(root.iter("li"))) == 3 and len(root.findall(".//ul/li")) == 3
    assert next(root.iter("script")).text == "if (a<b) '</p>'"
    assert next(root.iter("x")).get("y") == ">" and "3 < 4 " in "".join(root.itertext())


def test_tree_keeps_nested_tables_apart():
    root = parse("<table><tr><td>1<table><tr><td>in</table><td>2<tr><td>3</table>")
    outer = root.find("table")
    assert [len(row.findall("td")) for row in outer.findall("tr")] == [2, 1]


def test_many_stray_brackets_stay_linear():
    assert "".join(parse("a < b " * 50_000).itertext()).count("<") == 50_000


def test_regular_markup(spark):
    html = '<h1 class="x">T <b>u</b></h1><p>one<p>two</p><pre>no</pre><a class=k href="/a">A <i>b</i></a><a name="n">-</a>'
    df = spark.createDataFrame([(html,)], "html string")
    row = df.select(pages.first_element_text(F.col("html"), "h1").alias("h"),
                    pages.element_texts(F.col("html"), "p").alias("p"), pages.anchors(F.col("html")).alias("a")).first()
    assert row.h == "T u" and row.p == ["one", "two"] and [tuple(a) for a in row.a] == [("/a", "A b")]


def test_stored_reviews_are_extracted_once(spark, tmp_path, monkeypatch):
    """Items and quarantine of reviews that are stored equal those of the pages, which are not parsed again."""
    html = '<div id="expanded_review_1"><span class="noQuotes">T</span><span class="ratingDate">{}</span><div class="entry"><p>x</p></div></div>'
    table = spark.createDataFrame([("a", html.format("Reviewed May 12, 2013")), ("b", html.format("long ago")), ("c", "")], "url string, html string")
    threads = table.limit(0)
    want = [sorted(map(tuple, d.collect()), key=repr) for d in (posts.review_site_items(table, threads), posts.undated_reviews(table))]
    reviews = posts.stored_reviews(table)
    monkeypatch.setattr(posts.pages, "review_items", None)
    got = [sorted(map(tuple, d.collect()), key=repr) for d in (
        posts.review_site_items(table, threads, reviews=reviews), posts.undated_reviews(table, reviews))]
    assert got == want and [len(x) for x in got] == [1, 1]
