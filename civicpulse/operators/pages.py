"""Web pages to posts and links.

Regular markup is read with JVM expressions.  The three page layouts need nesting, so a
page goes through a small tree helper, in Arrow batches, after JVM filters have dropped
the pages that cannot yield anything.  Cleaning, dates and city matching stay on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html import escape
from xml.etree.ElementTree import Element

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..functions.markup import first_text, has_class, own_texts, parse, with_class
from ..params import FORUM_CITIES
from ..schemas import RAW_ITEM
from .match import topic_cities

Row = tuple
PAGE_COLUMNS = ("url", "city", "html")
ROWS_PER_FRAME = 10_000


def map_pages(pages: DataFrame, rows_of: Callable[..., Iterable[Row]], schema) -> DataFrame:
    """Run ``rows_of(url, city, html)`` on every page; one page may yield many rows."""
    names = schema.fieldNames()

    def frame(rows):
        # Object columns keep a missing value apart from a text.
        return pd.DataFrame(rows, columns=names, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                rows.extend(rows_of(page.url, page.city, page.html))
                if len(rows) >= ROWS_PER_FRAME:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    if "city" not in pages.columns:
        pages = pages.withColumn("city", F.lit(None).cast("string"))
    html = F.col("html")
    return pages.select(*PAGE_COLUMNS).where(html.isNotNull() & (html != "")).mapInPandas(run, schema)


# ---- layouts ----------------------------------------------------------------------

def forum_rows(url: str, city: str | None, root: Element) -> Iterator[Row]:
    """City-forum thread: topic in the navigation bar, one table per post."""
    topic = first_text([
        strong
        for cell in root.iter("td") if "alt1" in cell.get("class", "")
        for bar in cell.findall("./table/tr/td") if "navbar" in bar.get("class", "")
        for strong in bar.findall("./strong")])
    if topic is None:
        return
    posts = [t for t in root.iter("table") if "post" in t.get("id", "")]
    for position, post in enumerate(posts):
        message = [n for d in post.iter("div") if "post_message_" in d.get("id", "")
                   for n in own_texts(d)]
        side = [n
                for cell in post.iter("td") if has_class(cell, "alt2")
                for inner in cell.findall("./table/tr/td")
                if "top" in inner.get("valign", "").split()
                for div in inner.findall("./div/div[2]")
                for n in own_texts(div)]
        stamp = first_text([b for cell in post.iter("td") if has_class(cell, "thead")
                            for b in cell.findall("./div/span/span/b")])
        yield (url, position, city, topic, " ".join(message), "\n".join(side), None, stamp)


def review_rows(url: str, city: str | None, root: Element) -> Iterator[Row]:
    """Expanded reviews: one ``expanded_review...`` block per review."""
    blocks = [d for d in root.iter("div") if d.get("id", "").startswith("expanded_review")]
    for position, block in enumerate(blocks):
        paragraphs = [n for entry in with_class(block, "entry") for p in entry.findall("./p")
                      for n in own_texts(p)]
        marks = with_class(block, "ratingDate")
        stamp = next((m.get("title") for m in marks if "title" in m.attrib), None)
        yield (url, position, city, first_text(with_class(block, "noQuotes")),
               " ".join(paragraphs), first_text(with_class(block, "location")),
               stamp, first_text(marks))


def thread_rows(url: str, city: str | None, root: Element) -> Iterator[Row]:
    """Travel-forum thread: heading, and one ``post`` element per post."""
    heading = first_text([h for h in root.iter("h1") if h.get("id") == "HEADING"])
    for position, post in enumerate(with_class(root, "post")):
        # Bodies are taken as markup: a "<" of the text stays an entity when tags are cut.
        bodies = [escape("".join(b.itertext()), quote=False) for b in with_class(post, "postBody")]
        stamp = next((n for d in with_class(post, "postDate") for n in d.itertext()), None)
        yield (url, position, city, heading, " ".join(bodies),
               first_text(with_class(post, "location")), None, stamp)


#: What a page can hold, by name: its layout, and what the JVM looks for before it is parsed.
LAYOUTS = {"forum": forum_rows, "review": review_rows, "thread": thread_rows}
MARKS = {"forum": "post_message_", "review": "expanded_review", "thread": "postBody"}


def raw_items(pages: DataFrame, layout: str) -> DataFrame:
    """The items of all pages of one layout, as found."""
    rows = LAYOUTS[layout]
    return map_pages(pages.where(F.contains("html", F.lit(MARKS[layout]))),
                     lambda url, city, html: rows(url, city, parse(html)), RAW_ITEM)


# ---- posts ------------------------------------------------------------------------

def forum_items(pages: DataFrame, cities=FORUM_CITIES, as_of: Column | None = None) -> DataFrame:
    """Posts of threads whose topic starts with a city, once per such city.

    ``as_of`` is the reference time of ``Today`` and ``Yesterday``; give the crawl time.
    """
    return forum_posts(raw_items(pages, "forum"), cities, as_of)


def forum_posts(raw: DataFrame, cities=FORUM_CITIES, as_of: Column | None = None) -> DataFrame:
    found = raw.withColumn("topic", text.clean_topic(F.col("title")))
    return topic_cities(found.drop("city"), cities).select(
        "url", "position", "city", "topic",
        text.clean_forum_text(F.col("text")).alias("text"),
        text.location_label(F.col("geo")).alias("geo"),
        dates.forum_time(F.col("date_text"), as_of if as_of is not None else F.current_timestamp())
        .alias("date"),
        "date_text")


def review_items(pages: DataFrame) -> DataFrame:
    """Reviews with a date text; those without any are dropped.

    A date text that does not parse leaves ``date`` null; see ``undated``.
    """
    return review_posts(raw_items(pages, "review"))


def review_posts(raw: DataFrame) -> DataFrame:
    return raw.select(
        "url", "position", "city", text.clean_review_text(F.col("title")).alias("title"),
        text.clean_review_text(F.col("text")).alias("text"), "geo",
        dates.review_date(F.col("date_title"), F.col("date_text")).alias("date"),
        F.coalesce(F.nullif("date_title", F.lit("")), "date_text").alias("date_text"),
    ).where(F.coalesce(F.trim("date_text"), F.lit("")) != "")


def thread_items(pages: DataFrame) -> DataFrame:
    return thread_posts(raw_items(pages, "thread"))


def thread_posts(raw: DataFrame) -> DataFrame:
    return raw.select(
        "url", "position", "city", text.clean_review_text(F.col("title")).alias("title"),
        text.clean_review_text(F.col("text")).alias("text"), "geo",
        dates.post_date(F.col("date_text")).alias("date"), "date_text")


def dated(items: DataFrame) -> DataFrame:
    """Items whose date is known."""
    return items.where(F.col("date").isNotNull())


def undated(items: DataFrame) -> DataFrame:
    """Items whose date text did not parse: the quarantine of an extraction."""
    return items.where(F.col("date").isNull())


def detail_requests(pages: DataFrame) -> DataFrame:
    """Property pages with review ids to the url of their expanded reviews."""
    rest = [c for c in pages.columns if c not in ("url", "html")]
    return text.with_computed(pages, "detail", detail_of(F.col("url"), F.col("html"))).where(
        F.col("detail").isNotNull()).select(*rest, F.col("url").alias("page_url"), F.col("detail").alias("url"))


def detail_of(url: Column, html: Column) -> Column:
    """The url of a property page's expanded reviews; null for other pages."""
    tags = F.regexp_extract_all(
        html, F.lit(r"""(?s)<[^>]*class\s*=\s*["'][^"']*\breviewSelector\b[^>]*>"""), F.lit(0))
    named = F.transform(tags, lambda tag: F.regexp_extract(tag, r"""\sid\s*=\s*["']([^"']*)""", 1))
    own = F.flatten(F.transform(named, urls.review_ids))
    return urls.detail_url(url, own)


# ---- regular markup ---------------------------------------------------------------

def element_texts(html: Column, tag: str) -> Column:
    """Inner text of every ``<tag>`` up to its end or the next one of its kind."""
    inner = F.regexp_extract_all(
        html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?=</{tag}>|<{tag}[\s>]|$)"), F.lit(1))
    return F.transform(inner, text.clean_forum_text)


def first_element_text(html: Column, tag: str) -> Column:
    return F.get(element_texts(html, tag), F.lit(0))


def anchors(html: Column) -> Column:
    """``array<struct<link, link_text>>`` of the anchors in page order."""
    href = F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>.*?</a>""")
    label = F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>(.*?)</a>""")
    return F.zip_with(
        F.regexp_extract_all(html, href, F.lit(1)), F.regexp_extract_all(html, label, F.lit(1)),
        lambda link, inner: F.struct(link.alias("link"), text.clean_forum_text(inner).alias("link_text")))
