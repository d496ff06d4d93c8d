import json
from collections import Counter, defaultdict

import pytest

from civicpulse.operators import stats
from civicpulse.plans.registry import QUERIES
from civicpulse.schemas import POST

ROWS = [
    ("TWITTER", "chicago", ("Chicago", "US", "North America"), "positive", 3),
    ("TWITTER", "chicago", ("Atlantis", None, None), "negative", 2),
    ("TWITTER", "chicago", (None, None, None), "neutral", 1),
    ("TWITTER", "boston", ("Paris", "FR", "Europe"), None, 2),
    ("TWITTER", "boston", ("null", "US", "North America"), "positive", 1),
    ("TRIPADVISOR", "boston", ("Boston", "US", "North America"), "negative", 4),
    ("SKYSCRAPER", "boston", (None, None, None), "positive", 1),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(
        [(r, c, None, "t", g, s) for r, c, g, s, n in ROWS for _ in range(n)], POST)


CITIES = ("chicago", "boston")


def expected_dense(cities=CITIES):
    """The nested counting loops, one count per cell."""
    rows = [(r, c, g, s) for r, c, g, s, n in ROWS for _ in range(n)]
    out = {}
    for resource in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == resource]
        for name in cities:
            about = [r for r in mine if r[1] == name]
            for sentiment in ("positive", "negative", "all"):
                felt = [r for r in about if sentiment in ("all", r[3])]
                for i, level in enumerate(stats.LEVELS):
                    for value in {r[2][i] for r in mine}:
                        out[resource, name, sentiment, level, value] = sum(r[2][i] == value for r in felt)
                out[resource, name, sentiment, "total", None] = len(felt)
    return out


def as_dict(df):
    rows = df.select(*stats.STAT_KEYS, "n").collect()
    got = {tuple(r)[:-1]: r.n for r in rows}
    assert len(got) == len(rows)
    return got


def test_dense_equals_counting_loops(posts):
    assert as_dict(stats.stats_for(posts, CITIES)) == expected_dense()


@pytest.mark.parametrize("city", ["boston", "Boston", "nowhere"])
def test_one_city(posts, city):
    assert as_dict(stats.stats_for(posts, city)) == expected_dense([city.lower()])


def test_sparse_is_the_positive_part_of_dense(posts):
    got = as_dict(stats.sparse_stats(stats.cells(posts)))
    assert got == {k: n for k, n in expected_dense().items() if n or (k[3] == "total" and n)}


def test_levels_add_up(posts):
    sums, totals = defaultdict(Counter), {}
    for (r, c, s, level, _), n in as_dict(stats.stats_for(posts, CITIES)).items():
        if level == "total":
            totals[r, c, s] = n
        else:
            sums[level][r, c, s] += n
    for level in stats.LEVELS:
        assert dict(sums[level]) == totals
    for (r, c, _), n in totals.items():
        assert totals[r, c, "all"] >= totals[r, c, "positive"] + totals[r, c, "negative"]


def test_values_cities_totals_and_counts(posts):
    cells = stats.cells(posts)
    values = {tuple(r) for r in stats.geo_values(cells).collect()}
    assert ("TWITTER", "by_country", None) in values and len(values) == 11 + 3 + 3
    assert {tuple(r) for r in stats.all_cities(cells).collect()} == {(r, c) for r, c, *_ in ROWS}
    totals = {(r.resource, r.city): (r.total, r.positive, r.negative) for r in stats.post_totals(cells).collect()}
    assert totals["TWITTER", "chicago"] == (6, 3, 2) and totals["TWITTER", "boston"] == (3, 1, 0)
    count = lambda *a, **k: stats.count_posts(posts, *a, **k).first().n
    assert count("Chicago") == 6 and count("chicago", "negative") == 2
    assert count("chicago", geo={"country": None}) == 3
    assert count("chicago", "positive", {"continent": "North America", "country": "US"}) == 3


def test_source_by_name_in_any_case(posts):
    assert stats.posts_of(posts, "tripAdvisor").count() == 4
    assert stats.posts_of(posts, "other").count() == 0


def test_json_documents(posts):
    got = {tuple(r)[:4]: json.loads(r.stats)
           for r in stats.stats_documents(stats.stats_for(posts, CITIES)).collect()}
    want = defaultdict(dict)
    for (r, c, s, level, value), n in expected_dense().items():
        # A missing value and the text "null" share a name.
        cell = want[r, c, level, None if level == "total" else value or "null"]
        cell[s] = cell.get(s, 0) + n
    assert got == want


def test_many_geo_values_keep_the_shape(spark):
    rows = [("TWITTER", "rome", None, "t", (f"p{i}", "IT", "Europe"), "positive") for i in range(3000)]
    made = stats.stats_documents(stats.stats_for(spark.createDataFrame(rows, POST), "rome"))
    assert made.columns == ["resource", "city", "level", "geo", "stats"]
    assert made.count() == 3000 + 3 and made.select("resource", "city", "level", "geo").distinct().count() == 3003
    assert made.where("level = 'by_country'").first().stats == '{"positive":3000,"negative":0,"all":3000}'


def test_json_of_all_cities_has_the_zeros_of_their_source(spark, tmp_path):
    docs = [(0, "a", "rome"), (3, "b", "paris"), (1, "c", "oslo"), (30, "d", None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "X", 0), (1, "Y", 0), (3, "Z", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(
        str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    found = QUERIES["stats_json"](spark, str(tmp_path)).collect()
    cells = {(r.resource, r.city, r.level, r.geo): json.loads(r.stats) for r in found}
    nothing = {"positive": 0, "negative": 0, "all": 0}
    assert len(cells) == len(found) == 3 * (3 + 2 + 1 + 1) + 4
    assert cells["TWITTER", "rome", "by_country", "X"] == {"positive": 1, "negative": 0, "all": 1}
    assert cells["TWITTER", "rome", "by_country", "Z"] == nothing == cells["TWITTER", "paris", "by_city", "Town 30"]
    assert cells["TWITTER", None, "total", None]["all"] == 1
    assert ("TRIPADVISOR", "rome", "total", None) not in cells
