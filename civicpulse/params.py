"""Typed parameters: keywords, cities and languages per source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RESOURCES = ("TWITTER", "TRIPADVISOR", "SKYSCRAPER")

# The hashtags, cities and languages of the shipped configuration.
HASHTAGS = (
    "business", "smallbusiness", "money", "enterpreneur", "enterpreneurship", "biz",
    "smallbiz", "work", "company", "companies", "career", "careers", "job", "jobs",
    "economy", "finance",
)
STREAM_CITIES = ("chicago", "new york city", "boston")
REVIEW_CITIES = ("chicago", "new york city", "boston")
FORUM_CITIES = ("chicago", "new york", "boston")
LANGUAGES = ("en", "en-gb")
REVIEW_URL = "http://www.tripadvisor.com"
REVIEW_DOMAIN = "tripadvisor.com"
FORUM_URL = "http://forum.skyscraperpage.com"
FORUM_DOMAIN = "forum.skyscraperpage.com"


@dataclass(frozen=True)
class Parameters:
    hashtags: tuple[str, ...] = HASHTAGS
    stream_cities: tuple[str, ...] = STREAM_CITIES
    review_cities: tuple[str, ...] = REVIEW_CITIES
    forum_cities: tuple[str, ...] = FORUM_CITIES
    languages: tuple[str, ...] = LANGUAGES
    review_url: str = REVIEW_URL
    review_domain: str = REVIEW_DOMAIN
    forum_url: str = FORUM_URL
    forum_domain: str = FORUM_DOMAIN
    # Which trained model labels which source.
    models: dict[str, str] = field(default_factory=lambda: {
        "TWITTER": "twitter", "TRIPADVISOR": "reviews", "SKYSCRAPER": "reviews"})

    @classmethod
    def from_mapping(cls, config: dict) -> "Parameters":
        """Build from the nested mapping that a YAML or JSON parameter file holds."""
        stream, reviews, forum = (config.get(r, {}) for r in RESOURCES)
        return cls(
            hashtags=tuple(stream.get("HASHTAGS", HASHTAGS)),
            stream_cities=tuple(stream.get("CITIES", STREAM_CITIES)),
            languages=tuple(stream.get("LANGUAGES", LANGUAGES)),
            review_cities=tuple(reviews.get("CITIES", REVIEW_CITIES)),
            review_url=reviews.get("URL", REVIEW_URL),
            forum_cities=tuple(forum.get("CITIES", FORUM_CITIES)),
            forum_url=forum.get("URL", FORUM_URL),
        )

    def cities(self, resource: str) -> tuple[str, ...]:
        return {"TWITTER": self.stream_cities, "TRIPADVISOR": self.review_cities,
                "SKYSCRAPER": self.forum_cities}.get(resource.upper(), ())

    def city_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, c) for r in RESOURCES for c in self.cities(r)]
        return spark.createDataFrame(rows, "resource string, city string")

    def keyword_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Single-column tables of hashtags, stream cities and languages."""
        return {
            name: spark.createDataFrame([(v,) for v in values], f"{name} string")
            for name, values in (("hashtag", self.hashtags), ("city", self.stream_cities),
                                 ("language", self.languages))
        }
