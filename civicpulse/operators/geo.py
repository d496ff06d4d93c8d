"""Author locations to city, country and continent through a gazetteer.

A location matches every place whose name contains it; the most populous one wins.  The
substring join is a prefix search in a stored suffix index (``places``): distinct locations
are looked up there, and no location is ever paired with all its candidate places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_location
from ..session import run_dir, shared_dir
from .places import PlaceIndex, build_index, place_rank, rank_to_id
from .skew import broadcast_if_small, hot_keys, salted_join

# A location dictionary up to this size is broadcast; ROW_BYTES stands for its other columns.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 200


def with_place_key(df: DataFrame, location: str = "geo") -> DataFrame:
    return df.withColumn("place_key", F.lower(clean_location(F.col(location))))


def location_counts(df: DataFrame, location: str = "geo") -> DataFrame:
    """``place_key, n``: the distinct locations and how many rows have each."""
    return (
        with_place_key(df, location).where(F.col("place_key").isNotNull())
        .groupBy("place_key").agg(F.count(F.lit(1)).alias("n")))


def geography(gazetteer: DataFrame, continents: DataFrame) -> DataFrame:
    """``geoname_id, geo_city, geo_country, geo_continent`` of all places."""
    places = gazetteer.select(
        "geoname_id", F.col("asciiname").alias("geo_city"),
        F.col("country_code").alias("geo_country"))
    dimension = broadcast_if_small(continents.select(
        F.col("country_code").alias("geo_country"), F.col("continent").alias("geo_continent")))
    return places.join(dimension, "geo_country", "left")


def place_index(gazetteer: DataFrame, continents: DataFrame, path: str | None = None) -> PlaceIndex:
    """The stored suffix index of a gazetteer, in the shared folder if no path is given.

    A stream builds it once and looks each batch's locations up in it.
    """
    return build_index(
        gazetteer, geography(gazetteer, continents), path or run_dir(gazetteer.sparkSession, "places"))


def best_places(locations: DataFrame, gazetteer: DataFrame, index: PlaceIndex | None = None) -> DataFrame:
    """``place_key, geoname_id`` of the most populous place containing each key.

    ``locations`` holds distinct, non-null ``place_key`` values.
    """
    nowhere = gazetteer.select("country_code", F.lit(None).cast("string").alias("continent")).limit(0)
    return (index or place_index(gazetteer, nowhere)).lookup(locations).select("place_key", "geoname_id")


def enrich_locations(
    df: DataFrame,
    gazetteer: DataFrame,
    continents: DataFrame,
    location: str = "geo",
    source: DataFrame | None = None,
    index: PlaceIndex | None = None,
) -> DataFrame:
    """Replace the raw location by a ``geo`` struct of city, country and continent.

    No location gives three nulls; a location without a match keeps its raw text as city.
    ``source`` is a cheaper table with the same locations to count them in; ``index`` a
    stored ``place_index`` of the gazetteer, which is then not read.
    """
    shared_dir(df.sparkSession)
    # Both are written once: no later stage counts or resolves again, and the size of the
    # dictionary is known before the join.
    counts = location_counts(df if source is None else source, location).checkpoint()
    index = index or place_index(gazetteer, continents)
    names = index.lookup(counts).drop("population", "geoname_id").checkpoint()
    size = names.agg(F.sum(F.octet_length("place_key") + ROW_BYTES)).first()[0] or 0
    keyed = with_place_key(df, location)
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(names), "place_key", "left")
    else:
        # Hot keys come from the counts, because a frequent location may have no match.
        joined = salted_join(keyed, names, "place_key", hot_keys(counts, "place_key"), "left")
    raw = F.nullif(F.col(location), F.lit(""))
    return joined.withColumn("geo", F.struct(
        F.coalesce("geo_city", raw).alias("city"),
        F.col("geo_country").alias("country"),
        F.col("geo_continent").alias("continent"),
    )).drop("place_key", "geo_city", "geo_country", "geo_continent")
