import json

import pytest
from pyspark.sql import functions as F

from civicpulse.operators import bayes
from civicpulse.params import Parameters
from civicpulse.plans import posts as flow
from civicpulse.plans.registry import QUERIES
from civicpulse.schemas import COUNTRY_CONTINENT, GAZETTEER
from civicpulse.sources import readers
from civicpulse.streaming import ingest

PARAMS = Parameters(hashtags=("jobs",), stream_cities=("chicago", "boston"))
TEXTS = ["#jobs in Chicago", "#jobs chicago and #Boston boston", "#jobs rome", "chicago", None]


def line(i, text, lang="en"):
    return json.dumps({"text": text, "timestamp_ms": str(1425200400000 + i), "lang": lang,
                       "user": {"location": ["Oak Park, IL", "Nowhere", None][i % 3]}})


def setup(spark):
    places = spark.createDataFrame([(1, "Oak Park", "Oak Park", 5, "US")], GAZETTEER)
    continents = spark.createDataFrame([("US", "North America")], COUNTRY_CONTINENT)
    corpus = spark.createDataFrame([("jobs good", "positive"), ("boston bad", "negative")], "text string, label string")
    return places, continents, bayes.train(corpus)


def run(spark, tmp_path, parts):
    places, continents, model = parts
    stream = readers.stream_tweet_lines(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    query = ingest.start_tweets(
        stream, PARAMS, places, continents, model, str(tmp_path / "posts"), str(tmp_path / "state"),
        quarantine=str(tmp_path / "bad"), available_now=True)
    query.awaitTermination()
    return query


def rows(df):
    return sorted(map(repr, df.select("city", "date", "text", "geo", "sentiment").collect()))


def test_stream_equals_batch_and_restarts_add_nothing(spark, tmp_path):
    parts = setup(spark)
    (tmp_path / "in").mkdir()
    files = [[line(i, t) for i, t in enumerate(TEXTS)], [line(1, TEXTS[0]), line(2, TEXTS[1], "fr"), "{broken"]]
    (tmp_path / "in" / "0.json").write_text("\n".join(files[0]))
    run(spark, tmp_path, parts)
    (tmp_path / "in" / "1.json").write_text("\n".join(files[1]))
    run(spark, tmp_path, parts)
    streamed = readers.read_posts(spark, str(tmp_path / "posts"))
    tweets = readers.parse_tweets(readers.read_tweet_lines(spark, str(tmp_path / "in")))
    items = flow.tweet_items(readers.good_tweets(tweets), PARAMS)
    batch = flow.to_posts(items, "TWITTER", *parts)
    assert rows(streamed) == rows(batch) and len(rows(streamed)) == 5
    run(spark, tmp_path, parts)
    assert readers.read_posts(spark, str(tmp_path / "posts")).count() == 5
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    # What the stream has appended is what the report counts.
    total = flow.report(streamed, "boston").where("level = 'total' AND sentiment = 'all'").first().n
    assert total == 2


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    from civicpulse.sources.writers import write_batch_posts
    df = spark.createDataFrame([("TWITTER", "rome"), ("SKYSCRAPER", "rome")], "resource string, city string")
    for batch_id in (0, 1, 1):
        write_batch_posts(df, str(tmp_path / "p"), batch_id)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_url_dedupe(spark, tmp_path):
    source = tmp_path / "in"
    for day, urls in ((1, ["a", "b", "a"]), (2, ["b", "c"])):
        spark.createDataFrame([(u, f"2015-03-0{day} 00:00:00") for u in urls], "url string, ts string").withColumn(
            "ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(source))
    for name, time in (("forever", None), ("bounded", "ts")):
        stream = spark.readStream.schema("url string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(source))
        (ingest.dedupe_stream(stream, "url", time, "3 days").select("url").writeStream.format("parquet")
         .option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
         .trigger(availableNow=True).start().awaitTermination())
        assert sorted(r.url for r in spark.read.parquet(str(tmp_path / name)).collect()) == ["a", "b", "c"]


def test_a_failing_batch_stops_the_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(line(0, TEXTS[0]))

    def broken(batch):
        raise RuntimeError("no rows")

    stream = readers.stream_tweet_lines(spark, str(tmp_path / "in"))
    query = ingest.start_ingest(stream, broken, str(tmp_path / "p"), str(tmp_path / "s"), available_now=True)
    try:
        query.awaitTermination()
    except Exception as error:
        assert "no rows" in str(error)
    assert query.exception() is not None


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_posts_of_a_table_in_one_file_or_several(spark, tmp_path, files):
    said = ["the der", "que", "nothing", "the"]
    turns = spark.createDataFrame(
        [(i, t, "user", text) for i in range(4) for t, text in enumerate(said)], "conv_id bigint, turn bigint, role string, text string")
    table = tmp_path / "tables" / "conversations.parquet"
    turns.repartition(max(files, 1)).write.parquet(str(tmp_path / "written"))
    if files:
        turns.repartition(files).write.parquet(str(table))
    else:
        table.parent.mkdir()
        table.write_bytes(next((tmp_path / "written").glob("part-*")).read_bytes())
    found = [tuple(r) for r in QUERIES["stream_posts"](spark, str(table.parent)).collect()]
    assert sorted(found) == sorted((i, t, "user", w) for i in range(4) for t, text in enumerate(said) for w in text.split() if w != "nothing")


def test_stream_posts_without_a_city(spark, tmp_path):
    spark.createDataFrame([(1, 1, "user", "none")], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    assert QUERIES["stream_posts"](spark, str(tmp_path)).count() == 0
