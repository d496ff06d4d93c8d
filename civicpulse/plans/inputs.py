"""How the given tables stand in for posts, pages, places and a labelled corpus.

The expressions here are plain SQL that means the same in Spark and in the check
database, so each registered query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import broadcast_if_small
from ..sources.readers import spread_small

# Words of the documents that stand in for subject cities and keywords.
CITIES = ("tion", "the", "der", "que")
# Sources of the documents that stand in for the cities of a report; one has no posts.
ASKED_CITIES = ("src0", "src1", "src3", "nowhere")
# Cities that the three sources name: forum, reviews and travel forum, tweets.
SOURCE_CITIES = ("chicago", "new york", "en", "user", "la")
PHRASE_CITIES = ("of the", "de", "the and to")
HASHTAGS = ("and", "est", "und")
TRACK_CITIES = ("the of", "la", "der")
LANGUAGES = ("en", "fr", "de")
TOPIC_CITIES = ("The", "to the", "Is", "la", "t")
DOMAINS = ("example.org", "thther.example.com")

# A few words become hashtags, because the documents hold none.
TRACK_TEXT = "replace(replace(text, ' and ', ' #and '), ' est ', ' #Est ')"

LABEL = (
    "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'irrelevant' END")
SENTIMENT = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END"

RESOURCE = (
    "CASE doc_id % 3 WHEN 0 THEN 'TWITTER' WHEN 1 THEN 'TRIPADVISOR' ELSE 'SKYSCRAPER' END")
TOWN = (
    "CASE WHEN doc_id % 30 < 25 THEN 'Town ' || CAST(doc_id % 40 AS {text}) "
    "WHEN doc_id % 30 < 27 THEN 'somewhere' END")

# Author locations: with and without punctuation, in other case, partial, unknown, empty.
LOCATION = """CASE {id} % 8
  WHEN 0 THEN upper(p_name) || ', ' || p_brand
  WHEN 1 THEN split_part(p_name, ' ', 2)
  WHEN 2 THEN NULL
  WHEN 3 THEN ''
  WHEN 4 THEN ', ' || p_name
  WHEN 5 THEN p_brand
  WHEN 6 THEN p_name || '.'
  ELSE substr(p_name, 1, 5) END"""

SITE_SECTION = r"/[0-9]+.*$"


class Tables:
    """The given tables of one scale factor, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # Dates are compared as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        return spread_small(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def stream(self, name: str) -> DataFrame:
        """A table's rows as they come: one file, or a folder of files."""
        # A pattern, because the stream's reader takes a plain path for a folder.
        path = f"{self.folder}/{name}.parque[t]"
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(path)

    def corpus(self) -> DataFrame:
        """``doc_id, text, label`` of the labelled documents."""
        marks = self.labels.select("doc_id", F.expr(LABEL).alias("label"))
        return self.documents.select("doc_id", "text").join(marks, "doc_id")

    def gazetteer(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("geoname_id"), F.col("p_name").alias("name"),
            F.initcap("p_name").alias("asciiname"),
            F.col("p_size").cast("bigint").alias("population"),
            (F.col("p_partkey") % 25).cast("string").alias("country_code"))

    def continents(self) -> DataFrame:
        """Countries to continents; a few are left out, as codes without a continent."""
        return self.nation.where("n_nationkey <> 7").join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("string").alias("country_code"), F.col("r_name").alias("continent"))

    def customer_locations(self) -> DataFrame:
        names = self.part.select(F.col("p_partkey").alias("c_custkey"), "p_name", "p_brand")
        return self.customer.select("c_custkey").join(names, "c_custkey", "left").select(
            "c_custkey", F.expr(LOCATION.format(id="c_custkey")).alias("geo"))

    def posts(self, *keep: str) -> DataFrame:
        """Posts with given geography and sentiment; ``keep`` names columns to hold besides."""
        countries = self.nation.join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", "n_name", "r_name")
        docs = self.documents.select("doc_id", "source")
        located = docs.join(
            broadcast_if_small(countries), F.expr("doc_id % 30 = n_nationkey"), "left")
        return located.join(self.labels, "doc_id", "left").select(
            F.expr(RESOURCE).alias("resource"), F.col("source").alias("city"),
            F.struct(F.expr(TOWN.format(text="string")).alias("city"),
                     F.col("n_name").alias("country"), F.col("r_name").alias("continent")).alias("geo"),
            F.when(F.col("quality").isNotNull(), F.expr(SENTIMENT)).alias("sentiment"), *keep)

    def edges(self) -> DataFrame:
        """Link edges among customers computed from order keys."""
        n = self.customer.agg(F.count(F.lit(1))).scalar()
        return self.orders.select(
            F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("c/"), ((F.col("o_orderkey") * 7 + 13) % n).cast("string")).alias("dst"),
        )


def escaped(column: str):
    """A text as it appears in markup."""
    return F.replace(F.replace(F.col(column), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
