import json
from datetime import datetime

from civicpulse.operators import stats
from civicpulse.params import FORUM_CITIES, Parameters
from civicpulse.plans import posts as flow
from civicpulse.schemas import COUNTRY_CONTINENT, GAZETTEER, ITEM, PAGE, POST
from civicpulse.sources import readers, writers


def tweet(text, location, lang="en", ms="1425200400123"):
    return json.dumps({"text": text, "timestamp_ms": ms, "lang": lang, "user": {"location": location}, "extra": [1]})


def test_tweet_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join([
        tweet("hi", "Rome"), "{not json", '{"timestamp_ms": "1"}', tweet("yo", None, "fr", "x"),
        '{"text": "no user", "timestamp_ms": "2"}', '{"text": "no time"}']))
    rows = readers.parse_tweets(readers.read_tweet_lines(spark, str(tmp_path)))
    good = {(r.text, r.date, r.lang, r.location) for r in readers.good_tweets(rows).collect()}
    assert good == {("hi", datetime(2015, 3, 1, 9, 0, 0, 123000), "en", "Rome"), ("no user", datetime(1970, 1, 1, 0, 0, 0, 2000), None, None)}
    bad = [r[readers.CORRUPT] or "" for r in readers.bad_tweets(rows).collect()]
    assert sorted(bad) == sorted(["{not json", "", tweet("yo", None, "fr", "x"), '{"text": "no time"}'])


def test_corpus_by_position(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'id,label,x,y,text\n1,positive,,,"a, ""quoted"" word"\n2,irrelevant,,,"two\nlines"\n3,neutral,a,b,plain\n')
    path = str(tmp_path / "c.csv")
    rows = [tuple(r) for r in readers.read_corpus(spark, path, header=True).collect()]
    assert rows == [('a, "quoted" word', "positive"), ("two\nlines", "irrelevant"), ("plain", "neutral")]
    assert readers.read_corpus(spark, path).count() == 4
    assert readers.read_corpus(spark, path, text_col=0, label_col=2, columns=5, header=True).first().text == "1"


def test_dimensions(spark, tmp_path):
    place = ["5", "São \"P\"", "Sao P", "", "0", "0", "P", "PPL", "BR", "", "", "", "", "", "12", "", "", "", ""]
    (tmp_path / "places.txt").write_text("\t".join(place) + "\n")
    row = readers.read_geonames(spark, str(tmp_path / "places.txt")).first()
    assert tuple(row) == (5, 'São "P"', "Sao P", 12, "BR")
    country = "\t".join(["BR", "BRA", "076", "BR", "Brazil", "Brasilia", "1", "2", "SA"])
    namibia = "\t".join(["NA", "NAM", "516", "WA", "Namibia", "Windhoek", "1", "2", "AF"])
    (tmp_path / "country.txt").write_text(f"# comment\n#ISO\tx\n{country}\n{namibia}\n")
    got = readers.read_country_continents(spark, str(tmp_path / "country.txt")).collect()
    assert {tuple(r) for r in got} == {("BR", "South America"), ("NA", "Africa")}
    spark.createDataFrame([(1, "a", "b", 2, "US")], GAZETTEER).write.parquet(str(tmp_path / "g"))
    assert readers.read_gazetteer(spark, str(tmp_path / "g")).first().population == 2


def test_pages(spark, tmp_path):
    spark.createDataFrame([("u", "<p>", "rome")], PAGE).write.parquet(str(tmp_path / "pages"))
    assert readers.read_pages(spark, str(tmp_path / "pages")).first().city == "rome"
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text("<p>a\nb")
    row = readers.read_page_files(spark, str(tmp_path / "html")).first()
    assert row.url.endswith("a.html") and row.html == "<p>a\nb"


def test_parameters(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"TWITTER": {"CITIES": ["rome"], "LANGUAGES": ["it"]}}))
    params = readers.read_parameters(spark, str(tmp_path / "p.json"))
    assert params.stream_cities == ("rome",) and params.languages == ("it",) and params.forum_cities == FORUM_CITIES
    assert params.cities("twitter") == ("rome",) and params.cities("other") == ()
    assert Parameters().city_table(spark).count() == 9
    assert {k: v.count() for k, v in Parameters().keyword_tables(spark).items()} == {"hashtag": 16, "city": 3, "language": 2}


def test_posts_round_trip_with_pruning(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = [(r, "rome", None, "t", ("a", "b", "c"), "positive") for r in ("TWITTER", "TRIPADVISOR")]
    for row in rows:
        writers.append_posts(spark.createDataFrame([row], POST), path)
    assert {tuple(r) for r in readers.read_posts(spark, path).collect()} == set(rows)
    one = readers.read_posts(spark, path, "twitter")
    assert one.count() == 1 and readers.read_posts(spark, path, "other").count() == 0
    assert "PartitionFilters: [isnotnull(resource" in one._jdf.queryExecution().executedPlan().toString()


def test_stats_json_sink(spark, tmp_path):
    posts = spark.createDataFrame([("TWITTER", "rome", None, "t", ("a", "b", None), "positive")], POST)
    writers.write_stats(stats.stats_documents(flow.report(posts, "rome")), str(tmp_path / "s"))
    lines = spark.read.json(str(tmp_path / "s")).collect()
    assert {(r.level, r.geo, json.loads(r.stats)["all"]) for r in lines} == {
        ("by_city", "a", 1), ("by_country", "b", 1), ("by_continent", "null", 1), ("total", None, 1)}


def test_items_to_posts(spark, tmp_path):
    items = spark.createDataFrame([("Rome", "ciao", "Rome, IT", None), ("Rome", "x", None, None)], ITEM)
    stored = flow.store_items(items, str(tmp_path / "items"))
    places = spark.createDataFrame([(1, "Rome", "Rome", 3, "IT")], GAZETTEER)
    continents = spark.createDataFrame([("IT", "Europe")], COUNTRY_CONTINENT)
    drop_x = lambda df: df.where("text <> 'x'")
    posts = flow.to_posts(stored, "SKYSCRAPER", places, continents, hook=drop_x, stored=True)
    assert [tuple(r) for r in posts.collect()] == [("SKYSCRAPER", "rome", None, "ciao", ("Rome", "IT", "Europe"), None)]
    assert posts.columns == POST.fieldNames() and flow.empty_posts(spark).count() == 0


def test_reviews_are_stored_unless_switched_off(spark):
    review = '<div id="expanded_review1"><span class="ratingDate" title="April 2, 2014">x</span><div class="entry"><p>r</div></div>'
    thread = '<div class="post"><div class="postDate">Jan 3, 2016, 7:05 PM</div><div class="postBody">p</div></div>'
    a = spark.createDataFrame([("u", review, "rome")], PAGE)
    b = spark.createDataFrame([("v", thread, "rome")], PAGE)
    texts = lambda df: sorted(r.text for r in df.collect())
    assert texts(flow.review_site_items(a, b)) == ["p", "r"]
    assert texts(flow.review_site_items(a, b, persist_reviews=False)) == ["p"]
