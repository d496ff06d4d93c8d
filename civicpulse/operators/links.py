"""Links of pages: rules, first-rule-wins, url dedupe, domains and city lineage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit
from xml.etree.ElementTree import Element

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.markup import has_class, parse, with_class
from ..params import REVIEW_URL
from ..schemas import LINK
from ..session import delete_path, run_dir
from ..sources.buckets import Buckets
from .pages import map_pages
from .skew import SALTS, hot_keys

# What a link may start with, and endings of files that are no pages.
SCHEMES = ("http", "https", "ftp", "file")
SKIPPED_EXTENSIONS = frozenset(
    """
    mng pct bmp gif jpg jpeg png pst psp tif tiff ai drw dxf eps ps svg
    mp3 wma ogg wav ra aac mid au aiff
    3gp asf asx avi mov mp4 mpg qt rm swf wmv m4a
    xls xlsx ppt pptx pps doc docx odt ods odg odp
    css pdf exe bin rss zip rar
    """.split())


@dataclass(frozen=True)
class Rule:
    """Where links are found on a page, and user functions applied to what is found.

    ``regions`` yields the elements to search.  ``process_value`` rewrites a found value
    (None drops it); ``process_links`` and ``callback`` work on the table of all links or
    target pages of the rule.  ``layout`` names what the target pages are read for: posts of
    a layout of ``pages.LAYOUTS``, or a ``property`` page's expanded reviews.
    """

    name: str
    regions: Callable[[Element], list[Element]]
    tags: tuple[str, ...] = ("a", "area")
    attr: str = "href"
    process_value: Callable[[str], str | None] | None = None
    process_links: Callable[[DataFrame], DataFrame] | None = None
    callback: Callable[[DataFrame], DataFrame] | None = None
    layout: str | None = None


def by_class(*names: str) -> Callable[[Element], list[Element]]:
    return lambda root: with_class(root, *names)


def next_links(tag: str) -> Callable[[Element], list[Element]]:
    return lambda root: [e for e in root.iter(tag) if e.get("rel") == "next"]


def forum_index(root: Element) -> list[Element]:
    return [c for row in root.iter("tr") for c in row.findall("./td[2]") if has_class(c, "alt1")]


def forum_threads(root: Element) -> list[Element]:
    return [d for row in root.iter("tr") for d in row.findall("./td[3]/div")]


def travel_threads(root: Element) -> list[Element]:
    return [b for table in root.iter("table") if has_class(table, "topics")
            for b in table.findall("./tr/td[2]/b")]


def click_target(value: str) -> str:
    return re.sub(urls.CLICK_TARGET, r"\1\2", value)


# The regions that the two sites' rules search, in rule order, and what the pages
# behind them are read for.
FORUM_RULES = (
    Rule("forum", forum_index),
    Rule("next_page", next_links("a")),
    Rule("thread", forum_threads, layout="forum"),
)
REVIEW_RULES = (
    Rule("category", by_class("navLinks")),
    Rule("next_page", next_links("link"), tags=("link",), layout="property"),
    Rule("city_search_result", by_class("result", "GEOS"), tags=("div",), attr="onclick",
         process_value=click_target),
    Rule("sidebar_category", by_class("accommodation_type")),
    Rule("property", by_class("property_title"), layout="property"),
    Rule("forum_thread", travel_threads, layout="thread"),
    Rule("forum_pagination", by_class("pgLinks"), layout="thread"),
)


def followable(base: str, value: str) -> str | None:
    """The absolute link in a comparable form: sorted query, no fragment.

    None for other schemes than the web's and for files that hold no page.
    """
    try:
        parts = urlsplit(urljoin(base, value.strip()))
    except ValueError:
        return None
    if parts.scheme not in SCHEMES or parts.path.lower().rpartition(".")[2] in SKIPPED_EXTENSIONS:
        return None
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return urlunsplit((parts.scheme, parts.netloc.lower(), parts.path or "/", query, ""))


def link_rows(rules: Sequence[Rule]) -> Callable[[str, str | None, Element], Iterator[tuple]]:
    """``url, city, rule, link, link_text`` of a parsed page."""
    searches = [(r.regions, r.tags, r.attr, r.process_value or str) for r in rules]

    def rows_of(url: str, city: str | None, root: Element) -> Iterator[tuple]:
        base = urljoin(url, next((b.get("href", "") for b in root.iter("base")), ""))
        for index, (regions, tags, attr, process) in enumerate(searches):
            for region in regions(root):
                for element in region.iter():
                    found = element.get(attr) if element.tag in tags else None
                    value = process(found) if found else None
                    link = followable(base, value) if value else None
                    if link:
                        yield (url, city, index, link, "".join(element.itertext()))
    return rows_of


def with_markup(pages: DataFrame) -> DataFrame:
    """Pages that can hold elements; others, null ones too, give neither links nor posts."""
    return pages.where(F.contains("html", F.lit("<")))


def page_links(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``url, city, rule, link, link_text`` of all rules; a page without HTML gives none."""
    rows = link_rows(rules)
    return apply_hooks(map_pages(with_markup(pages), lambda url, city, html: rows(url, city, parse(html)), LINK), rules)


def apply_hooks(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Run the per-rule functions on the links they belong to."""
    hooked = {i: r.process_links for i, r in enumerate(rules) if r.process_links}
    if not hooked:
        return links
    parts = [links.where(~F.col("rule").isin(*hooked))]
    parts += [hook(links.where(F.col("rule") == i)) for i, hook in hooked.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def first_rule(links: DataFrame) -> DataFrame:
    """Keep each link of a page under the first rule that finds it."""
    keys = [c for c in links.columns if c != "rule"]
    return links.groupBy(*keys).agg(F.min("rule").alias("rule"))


def requests(
    pages: DataFrame, rules: Sequence[Rule], process_request: Callable | None = None
) -> DataFrame:
    """Links to follow with rule index, link text and the page's city."""
    found = first_rule(page_links(pages, rules))
    return process_request(found) if process_request else found


def run_callbacks(followed: DataFrame, pages: DataFrame, rules: Sequence[Rule]) -> dict[str, DataFrame]:
    """Per rule with a callback: the callback's result on the pages its links lead to."""
    results = {}
    for index, rule in enumerate(rules):
        if rule.callback:
            wanted = followed.where(F.col("rule") == index).groupBy(F.col("link").alias("url")).agg(
                F.min("city").alias("city"))
            results[rule.name] = rule.callback(pages.drop("city").join(wanted, "url"))
    return results


def in_domains(df: DataFrame, domains: Sequence[str], url: str = "url") -> DataFrame:
    keep = F.lit(False)
    for domain in domains:
        keep = keep | urls.in_domain(F.col(url), domain)
    return df.where(keep)


def first_seen(
    df: DataFrame, order: str, url: str = "url", normalize: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The first row of each url; ``order`` is a unique, comparable arrival number.

    Winners are found on (url, order) alone, combined before the shuffle.  The wide rows
    then move once, by their unique number, so a url with many copies makes no hot task.
    """
    key = normalize(F.col(url)) if normalize else F.col(url)
    winners = df.groupBy(key.alias("first_url")).agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def unseen(df: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose url is not among the already seen ones."""
    return df.join(seen.select(url), url, "left_anti")


def seed_cities(search_urls: DataFrame, base: str = REVIEW_URL) -> DataFrame:
    """``url, city`` of the search pages among the given urls."""
    city = urls.search_city(F.col("url"), base)
    return search_urls.select("url", city.alias("city")).where(F.col("city").isNotNull())


def link_buckets(edges: DataFrame, path: str) -> tuple[Buckets, DataFrame]:
    """Links between different urls, bucketed by their start; and the hashes of the starts that
    hold a large share of all links.

    The links of such a page are dealt to ``SALTS`` buckets, so no task follows them alone.  The
    distinct links, and how many each page has, are written first, since both are read twice.
    """
    spark = edges.sparkSession
    links = stored(edges.select("src", "dst").where("src <> dst").distinct(), f"{path}-distinct")
    degrees = stored(links.groupBy("src").agg(F.count(F.lit(1)).alias("n")), f"{path}-degrees")
    hot = hot_keys(degrees, "src").checkpoint()
    salt = F.when(F.col("hot_hash").isNotNull(), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = links.join(F.broadcast(hot), F.xxhash64("src") == F.col("hot_hash"), "left").withColumn("salt", salt)
    held = Buckets(spark, path, ("src", "salt"))
    held.append(salted.select("src", "salt", "dst"))
    for name in ("distinct", "degrees"):
        delete_path(spark, f"{path}-{name}")
    return held, hot


def stored(rows: DataFrame, path: str) -> DataFrame:
    """The rows as a plain table under ``path``."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def next_reached(links: DataFrame, hot: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """``url, city, depth``: the urls that links lead to from those reached one round before,
    and that no round has reached yet.

    ``links`` lie in buckets of (src, salt) and ``visited`` in buckets of url: only the rows of
    the last round, and the urls they lead to, are shuffled.
    """
    salts = F.when(F.col("hot_hash").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    last = visited.where(F.col("depth") == depth - 1).select(F.col("url").alias("src"), "city")
    sources = last.join(F.broadcast(hot), F.xxhash64("src") == F.col("hot_hash"), "left").select(
        "src", "city", F.explode(salts).alias("salt"))
    reached = links.join(sources, ["src", "salt"]).groupBy(F.col("dst").alias("url")).agg(F.min("city").alias("city"))
    # Without the hint the larger of the two sides could be broadcast.
    return reached.join(visited.select("url").hint("merge"), "url", "left_anti").withColumn("depth", F.lit(depth))


def propagate_cities(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``url, city, depth`` of every url reached from a seed; each url is reached once.

    A url takes the city of the page that reaches it first; if several do in the same
    round, the smallest city.  Links and reached urls are written once, bucketed by their
    keys; a round moves what the round before reached and adds what it reaches.  All of it is
    in the shared folder, so a lost executor costs no earlier round.
    """
    spark = edges.sparkSession
    folder = run_dir(spark, "lineage")
    links, hot = link_buckets(edges, f"{folder}/links")
    visited, depth = Buckets(spark, f"{folder}/visited", ("url",), "depth"), 0
    visited.append(seeds.groupBy("url").agg(F.min("city").alias("city")).withColumn("depth", F.lit(0)))
    while max_depth is None or depth < max_depth:
        if not visited.read().where(F.col("depth") == depth).limit(1).count():
            break
        depth += 1
        visited.append(next_reached(links.read(), hot, visited.read(), depth))
    links.close()
    return visited.close().select("url", "city", "depth")
