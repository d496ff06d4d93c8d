import random

from pyspark.sql import functions as F

from civicpulse.operators import geo, places
from civicpulse.schemas import COUNTRY_CONTINENT, GAZETTEER

PLACES = [
    (1, "Springfield", "Springfield", 100, "US"), (2, "Springfield", "Springfield IL", 900, "US"),
    (3, "Chicago", "Chicago", 2_700_000, "US"), (4, "Chicago Heights", "Chicago Heights", 30_000, "US"),
    (5, "São Paulo", "Sao Paulo", 12_000_000, "BR"), (6, "Tie", "Tie Six", 5, "XX"), (7, "Tie", "Tie Seven", 5, "US"),
    (8, "C++ (Town)", "Cpp", None, "US"), (9, "", "Nameless", 10, "US"),
]
CONTINENTS = [("US", "North America"), ("BR", "South America")]


def located(spark, locations):
    df = spark.createDataFrame(list(enumerate(locations)), "id int, geo string")
    gazetteer = spark.createDataFrame(PLACES, GAZETTEER)
    continents = spark.createDataFrame(CONTINENTS, COUNTRY_CONTINENT)
    rows = geo.enrich_locations(df, gazetteer, continents).collect()
    return [tuple(r.geo) for r in sorted(rows, key=lambda r: r.id)]


def test_enrichment_cases(spark):
    got = located(spark, ["chicago, IL", "CHICAGO", "springfield", "heights", "são paulo", "tie", "C++", "c++ (town",
                          "Atlantis, Sea", ", x", "", None])
    us = ("US", "North America")
    assert got == [
        ("Chicago", *us), ("Chicago", *us), ("Springfield IL", *us), ("Chicago Heights", *us),
        ("Sao Paulo", "BR", "South America"), ("Tie Six", "XX", None), ("Cpp", *us), ("Cpp", *us),
        ("Atlantis, Sea", None, None), (", x", None, None), (None, None, None), (None, None, None)]


def brute_force(key, rows):
    hits = [p for p in rows if key in p[1].lower()]
    return max(hits, key=lambda p: (p[3] or 0, -p[0]))[0] if hits else None


def test_best_places_equal_brute_force(spark):
    rng = random.Random(7)
    name = lambda n: "".join(rng.choice("ab c") for _ in range(n)).strip() or "a"
    rows = [(i, name(rng.randint(1, 12)), f"p{i}", rng.randint(0, 5), "US") for i in range(300)]
    keys = sorted({name(rng.randint(1, 6)) for _ in range(200)})
    found = geo.best_places(spark.createDataFrame([(k,) for k in keys], "place_key string"),
                            spark.createDataFrame(rows, GAZETTEER))
    got = {r.place_key: r.geoname_id for r in found.collect()}
    assert got == {k: b for k in keys if (b := brute_force(k, rows)) is not None}


def test_large_dictionary_takes_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(geo, "BROADCAST_BYTES", -1)
    assert located(spark, ["chicago"] * 40 + [None] * 20 + ["nowhere"]) == (
        [("Chicago", "US", "North America")] * 40 + [(None, None, None)] * 20 + [("nowhere", None, None)])


def test_rank_round_trip_of_extreme_values(spark):
    rows = [(0, 0), (9223372036854775807, 9223372036854775807), (5, 1)]
    df = spark.createDataFrame(rows, "p bigint, id bigint")
    rank = geo.place_rank(F.col("p"), F.col("id"))
    assert [r[0] for r in df.select(geo.rank_to_id(rank)).collect()] == [r[1] for r in rows]


def plan_text(df):
    return df._jdf.queryExecution().toString()


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(places, "BUCKET_ROWS", 40)
    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("abcdé 日") for _ in range(n)).strip() or "a"
    rows = [(i, name(rng.randint(1, 14)), f"p{i}", rng.randint(0, 9), "US") for i in range(400)]
    gazetteer = spark.createDataFrame(rows, GAZETTEER)
    index = geo.place_index(gazetteer, spark.createDataFrame(CONTINENTS, COUNTRY_CONTINENT), str(tmp_path / "index"))
    keys = sorted({name(rng.randint(1, 5)) for _ in range(150)} | {"a", "日", "é", "zzz", " ", "￿"})
    found = index.lookup(spark.createDataFrame([(k,) for k in keys], "place_key string"))
    got = {r.place_key: r.geoname_id for r in found.collect()}
    assert got == {k: b for k in keys if (b := brute_force(k, rows)) is not None}
    assert index.buckets().num_rows > 20
    # The folders of other buckets are not listed, so their files are not opened.
    one = index.lookup(spark.createDataFrame([(rows[0][1],)], "place_key string"))
    filters = [x.split("]")[0] for x in plan_text(one).split("PartitionFilters: [")[1:]]
    assert any("bucket" in x for x in filters)
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in index.suffixes([3, 5]).inputFiles()}
    assert len(index.suffixes([3, 5]).select(F.input_file_name().alias("f")).distinct().collect()) == 2 and len(read) > 20
    assert index.lookup(spark.createDataFrame([], "place_key string")).count() == 0


def test_empty_gazetteer_finds_nothing(spark, tmp_path):
    none = spark.createDataFrame([], GAZETTEER)
    index = geo.place_index(none, spark.createDataFrame(CONTINENTS, COUNTRY_CONTINENT), str(tmp_path / "index"))
    assert index.lookup(spark.createDataFrame([("a",)], "place_key string")).count() == 0


def test_many_keys_of_one_bucket_are_split(spark, monkeypatch):
    monkeypatch.setattr(places, "PART_KEYS", 3)
    df = spark.createDataFrame([(f"place {i}",) for i in range(40)] + [("spring",)], "place_key string")
    found = geo.best_places(df, spark.createDataFrame(PLACES, GAZETTEER)).collect()
    assert [tuple(r) for r in found] == [("spring", 2)]
