"""A site's stored pages from its start urls to posts, rule by rule, to the fixpoint.

A worklist of requests: each url is requested once, under the rule that found it.  A round
joins the requests of the round before with the stored pages, parses each page once, and gets
from it both the links of all rules and, if the rule has a layout, what the page was
requested for.  Pages and requests lie in buckets of their url, so a round shuffles its own
requests and links alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import parse
from ..session import run_dir
from ..sources.buckets import Buckets
from ..schemas import LINK, RAW_ITEM
from .links import FORUM_RULES, REVIEW_RULES, Rule, apply_hooks, first_rule, in_domains, link_rows, with_markup
from .pages import LAYOUTS, MARKS, detail_of, map_pages

#: Rules of start urls and of expanded reviews, which no link rule finds.
START, DETAIL = -1, -2
#: One row for each link or item of a page.
FOUND = T.StructType([
    *LINK.fields, *[T.StructField(f.name, f.dataType) for f in RAW_ITEM.fields if f.name not in ("url", "city")],
    T.StructField("layout", T.StringType())])


@dataclass(frozen=True)
class Site:
    rules: Sequence[Rule]
    domains: Sequence[str]

    def layout_of(self) -> F.Column:
        """The layout that the target pages of ``rule`` are read for."""
        named = {DETAIL: "review", **{i: r.layout for i, r in enumerate(self.rules) if r.layout}}
        pairs = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
        return F.try_element_at(pairs, F.col("rule"))


FORUM_SITE = Site(FORUM_RULES, ("forum.skyscraperpage.com",))
REVIEW_SITE = Site(REVIEW_RULES, ("tripadvisor.com",))


def read_once(fetched: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Links and items of fetched pages (url, city, html, layout, detail), from one parse.

    The layout and a known detail url ride in the ``city`` column's place through the helper.
    """
    rows, n = link_rows(rules), len(RAW_ITEM.fields) - 2

    def rows_of(url: str, packed: dict, html: str) -> Iterator[tuple]:
        city, layout, detail = packed["city"], packed["layout"], packed["detail"]
        if detail:
            yield (url, city, DETAIL, detail, None, *[None] * n, None)
        root = parse(html)
        if layout != "review":
            for link in rows(url, city, root):
                yield (*link, *[None] * n, None)
        if layout in LAYOUTS and MARKS[layout] in html:
            for item in LAYOUTS[layout](url, city, root):
                _, position, _, *rest = item
                yield (url, city, None, None, None, position, *rest, layout)

    packed = with_markup(fetched).withColumn("city", F.struct("city", "layout", "detail"))
    return map_pages(packed, rows_of, FOUND)


def fetch(requests: DataFrame, pages: DataFrame, site: Site) -> DataFrame:
    """Requests that a stored page answers, with what the page is read for."""
    layout = site.layout_of()
    met = requests.join(pages, "url").withColumn("layout", layout)
    detail = F.when(F.col("layout") == "property", detail_of(F.col("url"), F.col("html")))
    return met.select("url", "city", "html", "layout", detail.alias("detail"))


def crawled(start: DataFrame, pages: DataFrame, site: Site, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw items with their ``layout``, and the requests ``url, city, rule, depth``.

    ``start`` has ``url, city``, ``pages`` has ``url, html``.  A link is followed once, in the
    round that finds it first; of several finds in one round the smallest city and then the
    first rule count.  A page takes the city of its request.  Links to other domains are not
    followed, and pages that nothing links to are not read.  A url that is stored twice is
    read with its least markup.
    """
    spark = pages.sparkSession
    folder = run_dir(spark, "site")
    stored = Buckets(spark, f"{folder}/pages", ("url",))
    stored.append(pages.where("url IS NOT NULL").groupBy("url").agg(F.min("html").alias("html")))
    asked, depth = Buckets(spark, f"{folder}/requests", ("url",), "depth"), 0
    first = F.min(F.struct("city", "rule")).alias("first")
    asked.append(start.withColumn("rule", F.lit(START)).groupBy("url").agg(first).select(
        "url", "first.city", "first.rule", F.lit(depth).alias("depth")))
    while True:
        now = asked.read().where(F.col("depth") == depth)
        if not now.limit(1).count():
            break
        where = f"{folder}/found/depth={depth}"
        read_once(fetch(now.drop("depth"), stored.read(), site), site.rules).write.parquet(where)
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
        links = spark.read.schema(FOUND).parquet(where).where("link IS NOT NULL").select(*LINK.fieldNames())
        followed = in_domains(first_rule(apply_hooks(links, site.rules)), site.domains, "link")
        new = followed.groupBy(F.col("link").alias("url")).agg(first).select("url", "first.city", "first.rule")
        asked.append(new.join(asked.read().select("url").hint("merge"), "url", "left_anti").withColumn("depth", F.lit(depth)))
    stored.close()
    items = spark.read.schema(FOUND).parquet(f"{folder}/found").where("layout IS NOT NULL")
    return items.select(*RAW_ITEM.fieldNames(), "layout"), asked.close().select("url", "city", "rule", "depth")
