from datetime import datetime

import pytest
from pyspark.sql import functions as F

from civicpulse.functions import dates, urls


def one(spark, column):
    return spark.range(1).select(column).first()[0]


AS_OF = "2015-03-01 09:00:00"


@pytest.mark.parametrize("shown, expected", [
    ("Today, 1:05 PM", datetime(2015, 3, 1, 13, 5)),
    ("Today, 12:05 AM", datetime(2015, 3, 1, 0, 5)),
    ("Yesterday, 11:59 PM", datetime(2015, 2, 28, 23, 59)),
    ("Yesterday at noon", None),
    ("Today, 13:00 PM", None),
    ("Mar 7, 2015, 9:30 AM", datetime(2015, 3, 7, 9, 30)),
    ("Mar 07, 2015, 09:30 AM", datetime(2015, 3, 7, 9, 30)),
    ("7.3.2015", None),
    (None, None),
])
def test_forum_time(spark, shown, expected):
    assert one(spark, dates.forum_time(F.lit(shown).cast("string"), F.lit(AS_OF).cast("timestamp"))) == expected


@pytest.mark.parametrize("title, body, expected", [
    ("April 2, 2014", "x", datetime(2014, 4, 2)),
    (None, "Reviewed May 12, 2013 by phone", datetime(2013, 5, 12)),
    ("", "Reviewed May 12, 2013", datetime(2013, 5, 12)),
    (None, "Visited May 12, 2013", None),
    ("soon", "Reviewed May 12, 2013", None),
])
def test_review_date(spark, title, body, expected):
    assert one(spark, dates.review_date(F.lit(title).cast("string"), F.lit(body))) == expected


def test_epoch(spark):
    assert one(spark, dates.epoch_millis(F.lit("1425200400123"))) == datetime(2015, 3, 1, 9, 0, 0, 123000)
    assert one(spark, dates.epoch_millis(F.lit("x"))) is None


def test_search_urls(spark):
    url = urls.search_url(F.lit("new york city"))
    assert one(spark, url) == "http://www.tripadvisor.com/Search?q=new+york+city"
    assert one(spark, urls.search_city(url)) == "new york city"
    assert one(spark, urls.search_city(url, strict=True)) == "new"
    assert one(spark, urls.search_city(F.lit("http://www.tripadvisor.com/Hotels?q=x"))) is None


def test_detail_url(spark):
    page = F.lit("http://www.tripadvisor.com/Hotel_Review-g1-d22-Reviews-Inn.html")
    ids = F.array(F.lit("7"), F.lit("9"))
    assert one(spark, urls.detail_url(page, ids)) == (
        "http://www.tripadvisor.com/ExpandedUserReviews-g1-d22?target=7&context=1&reviews=7,9"
        "&servlet=g1-d22Hotel_Review&expand=1")
    assert one(spark, urls.detail_url(page, F.array().cast("array<string>"))) is None
    assert one(spark, urls.detail_url(F.lit("http://x.org/a.html"), ids)) is None


@pytest.mark.parametrize("url, inside", [
    ("http://tripadvisor.com/x", True), ("https://www.TripAdvisor.com:80?x", True),
    ("http://nottripadvisor.com/", False), ("http://x.org/tripadvisor.com", False),
    ("http://u:p@www.tripadvisor.com/", True), ("nonsense", False),
])
def test_domain(spark, url, inside):
    assert one(spark, urls.in_domain(F.lit(url), "tripadvisor.com")) is inside


def test_click_target(spark):
    value = F.lit("ta.go('http://www.tripadvisor.com/ShowUrl/Tourism-g35805.html','x')")
    assert one(spark, urls.rewrite_click_target(value)) == "ta.go('http://www.tripadvisor.com/Tourism-g35805.html"
