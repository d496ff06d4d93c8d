"""Counts by source, subject city, sentiment and author geography.

Posts are first counted per distinct combination (``cells``), combined before the one
shuffle that reads posts.  Everything else works on those cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import RESOURCES
from ..session import shared_dir
from .skew import hot_keys, salted_join

SENTIMENTS = ("positive", "negative")
ALL = "all"
LEVELS = ("by_city", "by_country", "by_continent")
GEO_COLUMNS = ("geo_city", "geo_country", "geo_continent")
STAT_KEYS = ("resource", "city", "sentiment", "level", "geo")


def posts_of(posts: DataFrame, resource: str) -> DataFrame:
    """One source, by name in any case; an unknown name gives no rows."""
    return posts.where(F.col("resource") == resource.upper())


def cells(posts: DataFrame) -> DataFrame:
    """Posts per source, subject city, sentiment and geography."""
    return posts.groupBy(
        "resource", "city", "sentiment", F.col("geo.city").alias("geo_city"),
        F.col("geo.country").alias("geo_country"), F.col("geo.continent").alias("geo_continent"),
    ).agg(F.count(F.lit(1)).alias("n"))


def all_cities(cells: DataFrame) -> DataFrame:
    return cells.select("resource", "city").distinct()


def geo_values(cells: DataFrame) -> DataFrame:
    """Distinct geo values per source and level; null is a value."""
    pairs = F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(c).alias("geo"))
        for level, c in zip(LEVELS, GEO_COLUMNS)])
    return cells.select("resource", F.explode(pairs).alias("v")).select(
        "resource", "v.level", "v.geo").distinct()


def sparse_stats(cells: DataFrame) -> DataFrame:
    """``resource, city, sentiment, level, geo, n`` of every combination that occurs.

    ``sentiment`` is positive, negative or ``all``; ``all`` includes other and missing
    sentiments.
    """
    base = ["resource", "city"]
    sets = [base + s + g for s in ([], ["sentiment"]) for g in ([], *([c] for c in GEO_COLUMNS))]
    # grouping() tells a rolled-up column from a null value of it.
    level = F.lit("total")
    value: Column = F.lit(None).cast("string")
    for name, column in zip(LEVELS, GEO_COLUMNS):
        level = F.when(F.grouping(column) == 0, name).otherwise(level)
        value = F.when(F.grouping(column) == 0, F.col(column)).otherwise(value)
    grouped = cells.groupingSets(sets, "resource", "city", "sentiment", *GEO_COLUMNS).agg(
        F.grouping("sentiment").alias("any_sentiment"), level.alias("level"),
        value.alias("geo"), F.sum("n").alias("n"))
    return grouped.where(
        (F.col("any_sentiment") == 1) | F.col("sentiment").isin(*SENTIMENTS)
    ).select(
        "resource", "city",
        F.when(F.col("any_sentiment") == 1, ALL).otherwise(F.col("sentiment")).alias("sentiment"),
        "level", "geo", "n")


def dense_stats(cells: DataFrame, cities: str | Sequence[str]) -> DataFrame:
    """Stats of the asked cities, with a zero for each combination that does not occur.

    Each asked city is combined with every geo value of every source, even if the source
    has no posts on it.  The asked cities are a list of the caller; no zero is stored for
    cities that nobody asks for.
    """
    asked = sorted({c.lower() for c in ([cities] if isinstance(cities, str) else cities)})
    counted = sparse_stats(cells).where(F.col("city").isin(asked))
    totals = cells.select("resource", F.lit("total").alias("level"),
                          F.lit(None).cast("string").alias("geo")).distinct()
    values = geo_values(cells).unionByName(totals)
    names = F.array(*[F.lit(s) for s in (*SENTIMENTS, ALL)])
    zeros = values.withColumn("city", F.explode(F.lit(asked))).withColumn(
        "sentiment", F.explode(names)).withColumn("n", F.lit(0).cast("bigint"))
    # Counted rows are a subset of the grid, so a sum is the fill, nulls included.
    return (zeros.select(*STAT_KEYS, "n").unionByName(counted)
            .groupBy(*STAT_KEYS).agg(F.sum("n").alias("n")))


def dense_stats_of_all(cells: DataFrame) -> DataFrame:
    """Stats of every city of each source, with a zero for each geo value of that source that
    has no posts on the city.

    The grid is dealt out by city, a source's cities to many tasks.
    """
    totals = cells.select("resource", F.lit("total").alias("level"), F.lit(None).cast("string").alias("geo")).distinct()
    values = geo_values(cells).unionByName(totals)
    hot = hot_keys(cells.groupBy("resource").agg(F.sum("n").alias("n")), "resource")
    names = F.array(*[F.lit(s) for s in (*SENTIMENTS, ALL)])
    zeros = salted_join(all_cities(cells), values, "resource", hot).withColumn(
        "sentiment", F.explode(names)).withColumn("n", F.lit(0).cast("bigint"))
    return (zeros.select(*STAT_KEYS, "n").unionByName(sparse_stats(cells))
            .groupBy(*STAT_KEYS).agg(F.sum("n").alias("n")))


def post_totals(cells: DataFrame) -> DataFrame:
    """One row per source and city: all posts and those of each sentiment."""
    return cells.groupBy("resource", "city").agg(
        F.sum("n").alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("sentiment") == s, F.col("n"))), F.lit(0)).alias(s)
          for s in SENTIMENTS])


def count_posts(
    posts: DataFrame, city: str, sentiment: str | None = None,
    geo: dict[str, str | None] | None = None,
) -> DataFrame:
    """One count: equality on city, sentiment and any of the geo fields (null matches null)."""
    kept = posts.where(F.col("city") == city.lower())
    if sentiment is not None:
        kept = kept.where(F.col("sentiment") == sentiment)
    for name, value in (geo or {}).items():
        kept = kept.where(F.col(f"geo.{name}").eqNullSafe(F.lit(value)))
    return kept.agg(F.count(F.lit(1)).alias("n"))


def stats_documents(counted: DataFrame) -> DataFrame:
    """``resource, city, level, geo, stats``: one small JSON object per cell.

    ``counted`` is ``sparse_stats`` of all cities or ``dense_stats`` of some.  ``stats`` holds
    the counts ``positive``, ``negative`` and ``all``, zero where nothing was counted.  A
    missing geo value and the text "null" share the name "null"; the totals have no ``geo``.
    The shape does not depend on how many values there are, and no task holds a whole city.
    """
    named = F.when(F.col("level") != "total", F.coalesce("geo", F.lit("null")))
    body = F.to_json(F.struct(*[
        F.coalesce(F.sum(F.when(F.col("sentiment") == s, F.col("n"))), F.lit(0)).alias(s) for s in (*SENTIMENTS, ALL)]))
    return counted.withColumn("geo", named).groupBy("resource", "city", "level", "geo").agg(
        body.alias("stats"))


def stats_fragments(documents: DataFrame) -> DataFrame:
    """``position, fragment``: all ``stats_documents`` as one nested JSON text, in pieces.

    In order of ``position`` the fragments join to ``{source: {city: {"total": {..},
    "by_city": {geo: {..}}, ..}}}``.  Every row is a fragment that opens and closes what its
    neighbours do not share, so a city of any size is spread over many tasks.  Rows are
    sorted by range; at the ends of a range the neighbours are the other ranges' ends.
    """
    shared_dir(documents.sparkSession)
    keys = ("resource", "city", "level", "geo")
    rows = documents.where(F.col("resource").isNotNull() & F.col("city").isNotNull()).select(
        "resource", "city", F.when(F.col("level") == "total", "").otherwise(F.col("level")).alias("level"),
        F.coalesce("geo", F.lit("")).alias("geo"), "stats")
    ranged = rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()).checkpoint()
    here = F.struct(*keys[:3])
    within = Window.partitionBy("part").orderBy(*keys)
    lined = ranged.select(
        "*", F.row_number().over(within).alias("n"), F.lag(here).over(within).alias("before"),
        F.lead(here).over(within).alias("after"))
    # One row for each range, so few: how many rows come before, and the neighbours' keys.
    order = Window.orderBy("part")
    ends = ranged.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"))
    ends = ends.select(
        "part", (F.sum("rows").over(order) - F.col("rows")).alias("offset"), F.lag("last").over(order).alias("left"),
        F.lead("first").over(order).alias("right"))
    ends = ends.select("part", "offset", *[
        F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.{k}").alias(k) for k in keys[:3]])).alias(side)
        for side in ("left", "right")])
    lined = lined.join(F.broadcast(ends), "part").withColumn("before", F.coalesce("before", "left")).withColumn(
        "after", F.coalesce("after", "right"))

    def same(other: str, depth: int) -> Column:
        equal = [F.col(f"{other}.{k}") == F.col(k) for k in keys[:depth]]
        return F.coalesce(reduce(Column.__and__, equal), F.lit(False))

    def opening(column: str, *more: str) -> Column:
        quoted = F.to_json(F.struct(F.col(column).alias("k")))
        return F.concat(F.substr(quoted, F.lit(6), F.length(quoted) - 6), *map(F.lit, (":", *more)))

    total, nothing = F.col("level") == "", F.lit("")
    opened = F.concat(
        F.when(F.col("before").isNull(), "{").otherwise(","),
        F.when(same("before", 1), nothing).otherwise(opening("resource", "{")),
        F.when(same("before", 2), nothing).otherwise(opening("city", "{")),
        F.when(total, '"total":').when(same("before", 3), nothing).otherwise(opening("level", "{")),
        F.when(total, nothing).otherwise(opening("geo")))
    closed = F.concat(
        F.when(total | same("after", 3), nothing).otherwise("}"), F.when(same("after", 2), nothing).otherwise("}"),
        F.when(same("after", 1), nothing).otherwise("}"), F.when(F.col("after").isNull(), "}").otherwise(nothing))
    return lined.select((F.col("offset") + F.col("n")).alias("position"), F.concat(opened, "stats", closed).alias("fragment"))


def stats_for(posts: DataFrame, cities: str | Sequence[str],
              resources: Sequence[str] = RESOURCES) -> DataFrame:
    """Dense stats of several sources.  The cells are written once, so posts are read once."""
    shared_dir(posts.sparkSession)
    return dense_stats(cells(posts.where(F.col("resource").isin(*resources))).checkpoint(), cities)
