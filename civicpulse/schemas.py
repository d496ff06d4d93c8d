"""Declared schemas of every table that the package reads or writes."""

from pyspark.sql import types as T

GEO = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("continent", T.StringType()),
])

# One subject-city post before enrichment; ``geo`` is the author's raw location.
ITEM = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("geo", T.StringType()),
    T.StructField("date", T.TimestampType()),
])

POST = T.StructType([
    T.StructField("resource", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("geo", GEO),
    T.StructField("sentiment", T.StringType()),
])

TWEET = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("timestamp_ms", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("location", T.StringType())])),
])

PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("city", T.StringType()),
])

# Output of page extraction: texts and dates as found on the page.
RAW_ITEM = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("city", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("geo", T.StringType()),
    T.StructField("date_title", T.StringType()),
    T.StructField("date_text", T.StringType()),
])

LINK = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("rule", T.IntegerType()),
    T.StructField("link", T.StringType()),
    T.StructField("link_text", T.StringType()),
])

EDGE = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
])

GAZETTEER = T.StructType([
    T.StructField("geoname_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("asciiname", T.StringType()),
    T.StructField("population", T.LongType()),
    T.StructField("country_code", T.StringType()),
])

COUNTRY_CONTINENT = T.StructType([
    T.StructField("country_code", T.StringType()),
    T.StructField("continent", T.StringType()),
])
