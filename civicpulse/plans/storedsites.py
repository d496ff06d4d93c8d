"""The given pages as two stored sites: search pages, lists, property pages, reviews, threads.

Pages are dealt to cities by their number.  Of five pages two are properties with a review,
two are travel-forum threads, and one is stored but linked from nowhere; every seventh is also
a thread of the city forum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..params import FORUM_URL, REVIEW_CITIES, REVIEW_URL
from .inputs import Tables

PER_LIST = 150
#: Page numbers to what they are, in SQL that both sides read alike.
CITY = "CASE page_id % 3 WHEN 0 THEN 'chicago' WHEN 1 THEN 'new york city' ELSE 'boston' END"
IS_REVIEW, IS_THREAD, IS_FORUM = "page_id % 5 < 2", "page_id % 5 IN (2, 3)", "page_id % 7 = 0"
TEXT = "split_part(url, '?', 1)"


def joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def anchors(rows: DataFrame, keys: list[str], href: Column, shown: Column, before: str = "", after: str = "") -> DataFrame:
    """Per ``keys`` the anchors of all its rows as ``body``, in the order of the links."""
    anchor = joined(before, '<a href="', href, '">', shown, "</a>", after)
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(anchor)), "").alias("body"))


def start_urls(t: Tables) -> DataFrame:
    cities = t.spark.createDataFrame([(c,) for c in REVIEW_CITIES], "city string")
    return cities.select(urls.search_url(F.col("city")).alias("url"), "city")


def review_site(t: Tables) -> DataFrame:
    """``url, html`` of the review site, and of another domain that it links to."""
    pages = t.pages.select("page_id", F.expr(TEXT).alias("text"), (F.col("page_id") % 3).alias("g"),
                           F.floor(F.col("page_id") / PER_LIST).alias("o"))
    number, group = F.col("page_id"), F.col("g")
    towns = pages.select("g", "o").distinct()
    starts = t.spark.createDataFrame([(i, c) for i, c in enumerate(REVIEW_CITIES)], "g bigint, city string")
    search = starts.select(urls.search_url(F.col("city")).alias("url"), joined(
        '<div class="x result GEOS"><div onclick="', REVIEW_URL, "/s/Tourism-g", group, '.html?x=1">go</div></div>').alias("html"))
    town = starts.select(joined(REVIEW_URL, "/Tourism-g", group, ".html").alias("url"), joined(
        '<ul class="navLinks"><li><a href="/Hotels-g', group, '.html">Hotels</a><li><a href="/Forum-g', group, '.html">Forum</a>'
        '<li><a href="http://other.org/', group, '.html">Other</a></ul>').alias("html"))
    listed = lambda kind: joined("/", kind, "-g", group, "-o", F.col("o"), ".html")
    index = lambda kind, style: anchors(towns, ["g"], listed(kind), F.col("o")).select(
        joined(REVIEW_URL, "/", kind, "-g", group, ".html").alias("url"),
        joined('<div class="', style, '">', F.col("body"), "</div>").alias("html"))
    hotels = anchors(pages.where(IS_REVIEW), ["g", "o"], joined("/Hotel_Review-g", number, "-d7-Reviews.html"), number).select(
        joined(REVIEW_URL, listed("Hotels")).alias("url"),
        joined('<div class="property_title">', F.col("body"), "</div>").alias("html"))
    topics = anchors(pages.where(IS_THREAD), ["g", "o"], joined("/ShowTopic-g", number, ".html"), number,
                     "<tr><td>1<td><b>", "</b>").select(
        joined(REVIEW_URL, listed("Forum")).alias("url"),
        joined('<table class="t topics">', F.col("body"), "</table>").alias("html"))
    hotel_url = joined(REVIEW_URL, "/Hotel_Review-g", number, "-d7-Reviews.html")
    hotel = joined('<div class="reviewSelector" id="review_', number, '1"></div><div class="reviewSelector" id="review_', number, '2"></div>')
    ids = F.array(joined(number, "1"), joined(number, "2"))
    review = joined(
        '<div id="expanded_review_1"><span class="noQuotes">T</span><div class="location">Town ', number,
        '</div><span class="ratingDate" title="April 2, 2014">x</span><div class="entry"><p>', F.col("text"), "</div></div>")
    thread = joined(
        '<h1 id="HEADING">Talk</h1><div class="post"><div class="postDate"><span>Jan 5, 2016, 7:05 PM</span></div>'
        '<div class="location">Place ', number, '</div><div class="postBody"><p>', F.col("text"), "</p></div></div>"
        '<ul class="navLinks"><li><a href="/Tourism-g', group, '.html">back</a></ul>')
    parts = [
        search, town, index("Hotels", "accommodation_type"), index("Forum", "pgLinks"), hotels, topics,
        pages.where(IS_REVIEW).select(hotel_url.alias("url"), hotel.alias("html")),
        pages.where(IS_REVIEW).select(urls.detail_url(hotel_url, ids).alias("url"), review.alias("html")),
        # All pages have a thread; only some are linked.
        pages.select(joined(REVIEW_URL, "/ShowTopic-g", number, ".html").alias("url"), thread.alias("html")),
        starts.select(joined("http://other.org/", group, ".html").alias("url"), F.lit(
            '<div class="post"><div class="postBody">no</div></div>').alias("html"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def forum_site(t: Tables) -> DataFrame:
    """``url, html`` of the city forum: an index of two pages, forums, threads."""
    pages = t.pages.where(IS_FORUM).select("page_id", F.expr(TEXT).alias("text"), F.floor(F.col("page_id") / PER_LIST).alias("o"))
    number = F.col("page_id")
    forums = anchors(pages.select("o", (F.col("o") % 2).alias("half")).distinct(), ["half"], joined("/f", F.col("o"), ".html"),
                     F.col("o"), '<tr><td>x</td><td class="alt1">', "</td></tr>")
    more = F.when(F.col("half") == 0, F.lit('<a rel="next" href="/2.html">&gt;</a>')).otherwise(F.lit(""))
    index = forums.select(
        joined(FORUM_URL, F.when(F.col("half") == 0, "/").otherwise("/2.html")).alias("url"),
        joined("<table>", F.col("body"), "</table>", more).alias("html"))
    lists = anchors(pages, ["o"], joined("/t", number, ".html"), number, "<tr><td>1</td><td>2</td><td><div>", "</div></td></tr>").select(
        joined(FORUM_URL, "/f", F.col("o"), ".html").alias("url"), joined("<table>", F.col("body"), "</table>").alias("html"))
    topic = F.when(number % 2 == 0, F.lit("Chicago: ")).otherwise(F.lit("Old Boston "))
    thread = joined(
        '<table><tr><td class="alt1"><table><tr><td class="navbar"><strong>', topic, number, "</strong></td></tr></table></td></tr></table>"
        '<table id="post1"><tr><td class="thead"><div><span><span><b>Mar 7, 2015, 9:30 AM</b></span></span></div></td></tr>'
        '<tr><td class="alt2"><table><tr><td valign="top"><div><div>x</div><div>Location: Place ', number,
        '</div></div></td></tr></table></td><td><div id="post_message_1">', F.col("text"), "</div></td></tr></table>")
    threads = pages.select(joined(FORUM_URL, "/t", number, ".html").alias("url"), thread.alias("html"))
    return index.unionByName(lists).unionByName(threads)
