"""Table readers.  Every schema is declared; nothing is inferred."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import epoch_millis
from ..functions.text import with_computed
from ..operators.bayes import Model
from ..params import Parameters
from ..schemas import COUNTRY_CONTINENT, GAZETTEER, PAGE, POST, TWEET
from .segments import Segments

CORRUPT = "_corrupt_record"
STORED_POST = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POST.fields)
SMALL_SPLITS = 32

# The columns of the published GeoNames place and country dumps.
GEONAMES_COLUMNS = (
    "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude",
    "feature_class", "feature_code", "country_code", "cc2", "admin1", "admin2", "admin3",
    "admin4", "population", "elevation", "dem", "timezone", "modification_date")
COUNTRY_COLUMNS = (
    "iso", "iso3", "iso_numeric", "fips", "country", "capital", "area", "population",
    "continent")
# Continent codes.
CONTINENTS = {
    "AF": "Africa", "AN": "Antarctica", "AS": "Asia", "EU": "Europe",
    "NA": "North America", "OC": "Oceania", "SA": "South America"}


def spread_small(table: DataFrame) -> DataFrame:
    """Spread a table of few splits over the cores of a small session.

    Row-wise text work is bound by the processor.  A table of ``SMALL_SPLITS`` splits or
    more is never shuffled for this.
    """
    wanted = min(table.sparkSession.sparkContext.defaultParallelism, SMALL_SPLITS)
    return table.repartition(wanted) if table.rdd.getNumPartitions() < wanted else table


# ---- tweets -----------------------------------------------------------------------

def read_tweet_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """One JSON text per row, in ``value``."""
    return spark.read.options(**options).text(path)


def stream_tweet_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.readStream.options(**options).text(path)


def parse_tweets(lines: DataFrame, value: str = "value") -> DataFrame:
    """``text, date, lang, location`` and the whole line where it is not JSON or has no readable time.

    Works on batch and streaming lines alike, for example Kafka values cast to string.
    """
    schema = T.StructType([*TWEET.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = with_computed(lines.select(value), "j", F.from_json(value, schema, options))
    date = epoch_millis(F.col("j.timestamp_ms"))
    return parsed.select(
        F.col("j.text").alias("text"), date.alias("date"),
        F.col("j.lang").alias("lang"), F.col("j.user.location").alias("location"),
        F.coalesce(F.col(f"j.{CORRUPT}"), F.when(date.isNull(), F.col(value))).alias(CORRUPT))


def good_tweets(tweets: DataFrame) -> DataFrame:
    return tweets.where(F.col(CORRUPT).isNull() & F.col("text").isNotNull()).drop(CORRUPT)


def bad_tweets(tweets: DataFrame) -> DataFrame:
    """Quarantine: lines that are not JSON, or have no text or no readable time."""
    return tweets.where(F.col(CORRUPT).isNotNull() | F.col("text").isNull())


# ---- pages, corpora, dimensions ---------------------------------------------------

def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one file each; the url is the file's path."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_corpus(
    spark: SparkSession, path: str, text_col: int = 4, label_col: int = 1,
    columns: int | None = None, header: bool = False,
) -> DataFrame:
    """Text and label of a quoted CSV by position."""
    width = max(text_col, label_col) + 1 if columns is None else columns
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = (
        spark.read.schema(schema)
        .options(sep=",", quote='"', escape='"', multiLine=True, header=header,
                 enforceSchema=True, mode="PERMISSIVE")
        .csv(path))
    return rows.select(F.col(f"c{text_col}").alias("text"), F.col(f"c{label_col}").alias("label"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A places table saved with this package's schema."""
    return spark.read.schema(GAZETTEER).parquet(path)


def read_geonames(spark: SparkSession, path: str) -> DataFrame:
    """The published tab-separated dump of places."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in GEONAMES_COLUMNS])
    rows = spark.read.schema(schema).options(sep="\t", quote="", escape="").csv(path)
    return rows.select(
        F.col("geonameid").try_cast("bigint").alias("geoname_id"), "name", "asciiname",
        F.col("population").try_cast("bigint").alias("population"), "country_code")


def read_country_continents(spark: SparkSession, path: str) -> DataFrame:
    """Country code to continent name from the published tab-separated country list."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COUNTRY_COLUMNS])
    rows = spark.read.schema(schema).options(sep="\t", quote="", comment="#").csv(path)
    names = F.create_map(*[F.lit(x) for pair in CONTINENTS.items() for x in pair])
    return rows.select(
        F.col("iso").alias("country_code"), F.try_element_at(names, "continent").alias("continent")
    ).to(COUNTRY_CONTINENT)


def read_parameters(spark: SparkSession, path: str) -> Parameters:
    """Parameters from a JSON file with one section per source."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return Parameters.from_mapping(json.loads(text))


# ---- posts and models -------------------------------------------------------------

def read_posts(spark: SparkSession, path: str, resource: str | None = None) -> DataFrame:
    """All posts, or those of one source by partition pruning (any case).

    Of a store whose batches were merged, the segments and the batches behind them.
    """
    held = Segments(spark, path)
    if held.merged() >= 0:
        posts = held.rows(STORED_POST).select(*POST.fieldNames())
    else:
        posts = spark.read.schema(POST).parquet(path).select(*POST.fieldNames())
    return posts if resource is None else posts.where(F.col("resource") == resource.upper())


def read_batch_posts(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The posts that one batch of a stream has stored."""
    return Segments(spark, path).batches(STORED_POST, batch_id - 1, batch_id).drop("batch_id")


def load_model(spark: SparkSession, models_dir: str, data_source: str) -> Model | None:
    """The latest saved version of a model, or None if this source has none."""
    path = f"{models_dir}/{data_source}"
    try:
        meta = spark.read.parquet(f"{path}/meta").orderBy(F.desc("version")).first()
        features = spark.read.parquet(f"{path}/features-{meta['version']}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    labels = tuple((row["label"], row["n"]) for row in meta["labels"])
    return Model(labels, features, meta["n_features"], meta["feature_bytes"])


def load_models(spark: SparkSession, models_dir: str, sources: Mapping[str, str]) -> dict[str, Model | None]:
    """Per resource the model that its data source names; each is read once."""
    loaded = {name: load_model(spark, models_dir, name) for name in set(sources.values())}
    return {resource: loaded[name] for resource, name in sources.items()}
