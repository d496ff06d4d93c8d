"""From sources to stored posts, and from stored posts to the report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import bayes, geo, match, pages, stats
from ..params import Parameters
from ..schemas import POST
from ..session import run_dir

Hook = Callable[[DataFrame], DataFrame]


def tweet_items(tweets: DataFrame, params: Parameters, phrase_match: bool = False) -> DataFrame:
    """Tweets to ``cities, text, geo, date`` items, with one city per mention."""
    kept = match.language_filter(tweets, params.languages)
    kept = match.track_filter(kept, match.phrase_list(params.hashtags, params.stream_cities))
    return match.with_mentions(kept, params.stream_cities, phrase_match=phrase_match).select(
        "cities", "text", F.col("location").alias("geo"), "date")


def review_site_items(
    property_pages: DataFrame, thread_pages: DataFrame, persist_reviews: bool = True, reviews: DataFrame | None = None
) -> DataFrame:
    """Items of a review site: forum posts, and its dated reviews unless switched off.

    Reviews whose date text does not parse are in ``undated_reviews``.  ``reviews`` are the
    ``stored_reviews`` of the pages, which are then not extracted again.
    """
    columns = ("city", "text", "geo", "date")
    posts = pages.thread_items(thread_pages).select(*columns)
    if not persist_reviews:
        return posts
    found = pages.review_items(property_pages) if reviews is None else reviews
    return pages.dated(found).select(*columns).unionByName(posts)


def stored_reviews(property_pages: DataFrame) -> DataFrame:
    """The reviews of all pages, extracted once for items and quarantine."""
    return store_items(pages.review_items(property_pages), run_dir(property_pages.sparkSession, "reviews"))


def undated_reviews(property_pages: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Quarantine: reviews with a date text that is no date, as extracted."""
    return pages.undated(pages.review_items(property_pages) if reviews is None else reviews)


def forum_site_items(
    thread_pages: DataFrame, params: Parameters, as_of: Column | None = None
) -> DataFrame:
    return pages.forum_items(thread_pages, params.forum_cities, as_of).select(
        "city", "text", "geo", "date")


def to_posts(
    items: DataFrame,
    resource: str,
    gazetteer: DataFrame,
    continents: DataFrame,
    model: bayes.Model | None = None,
    key: str | None = None,
    tokens: Callable[[Column], Column] = tokenize,
    hook: Hook | None = None,
    stored: bool = False,
    index: geo.PlaceIndex | None = None,
) -> DataFrame:
    """Items to stored posts: location looked up, sentiment added, city in lower case.

    ``hook`` is a user function on the items; ``key`` a unique item column, if there is
    one.  Items with an array of ``cities`` become one post per entry, after the lookups,
    so that no shuffle carries the copies.  ``index`` is a stored place index (a stream's).

    The lookups read the items three times, mostly single columns.  So that filters and
    extraction run once, items are first written to the shared folder, unless they are
    ``stored`` already.  A row of that table has a fixed place in it, which then serves as
    the unique key.
    """
    if hook:
        items = items.transform(hook)
    row_key = key
    if not stored:
        items = store_items(items, run_dir(items.sparkSession, "items"))
        if key is None:
            row_key = "row_key"
            items = items.withColumn(row_key, place_in_files())
    labelled = bayes.classify(items, model, row_key, tokens=tokens)
    # Only the location column of the items is read to count the locations.
    labelled = geo.enrich_locations(labelled, gazetteer, continents, source=items, index=index)
    if "cities" in labelled.columns:
        labelled = labelled.withColumn("city", F.explode("cities"))
    extra = [key] if key else []
    return labelled.select(
        *extra, F.lit(resource).alias("resource"), F.lower("city").alias("city"), "date", "text",
        "geo", "sentiment")


def place_in_files() -> Column:
    """The place of a row in the files that one write made, as one number: the task that wrote
    it, which of the task's files, and the row in it."""
    part = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("bigint")
    return F.shiftleft(part(r"^part-(\d+)"), 44) + F.shiftleft(part(r"-c(\d+)"), 32) + F.col("_metadata.row_index")


def store_items(items: DataFrame, path: str) -> DataFrame:
    """Write items and read them back: extraction then runs once."""
    items.write.mode("overwrite").parquet(path)
    return items.sparkSession.read.schema(items.schema).parquet(path)


def report(posts: DataFrame, cities: str | Sequence[str]) -> DataFrame:
    """Zero-filled counts of the asked cities over the three sources."""
    return stats.stats_for(posts, cities)


def empty_posts(spark) -> DataFrame:
    return spark.createDataFrame([], POST)
