import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civicpulse.operators import stats
from civicpulse.schemas import POST
from civicpulse.sources import readers, writers
from civicpulse.sources.segments import Segments
from civicpulse.streaming import ingest
from civicpulse.streaming.cells import CellStore

CITIES, GEO = ["rome", 'o"slo\\', "nice", None], [None, "null", "a b", 'q"t', "é"]


def posts(spark, seed, n=40):
    draw = random.Random(seed)
    rows = [(draw.choice(["TWITTER", "SKYSCRAPER"]), draw.choice(CITIES), None, f"t{seed}/{i}",
             (draw.choice(GEO), draw.choice(GEO), draw.choice(GEO)), draw.choice(["positive", "negative", "odd", None])) for i in range(n)]
    return spark.createDataFrame(rows, POST).withColumn("date", F.timestamp_seconds(F.lit(86400 * seed)))


def key(row):
    return repr(tuple(row))


def counted(df):
    return sorted(map(key, stats.sparse_stats(df).select(*stats.STAT_KEYS, "n").collect()))


def test_cells_follow_batches_merges_and_replays(spark, tmp_path):
    store, batches = CellStore(spark, str(tmp_path / "cells"), merge_every=3), [posts(spark, i) for i in range(6)]
    every = None
    for i, batch in enumerate(batches):
        store.add(batch, i)
        store.add(batch, i)
        every = batch if every is None else every.unionByName(batch)
        assert counted(store.cells()) == counted(stats.cells(every))
    assert store.segments.merged() == 5 and len(store.segments.log()) == 1
    store.add(batches[4], 4)
    assert counted(store.cells()) == counted(stats.cells(every))
    assert sorted(map(key, store.report(["rome", "nowhere"]).collect())) == sorted(
        map(key, stats.dense_stats(stats.cells(every), ["rome", "nowhere"]).collect()))
    store.segments.clean()
    assert counted(store.cells()) == counted(stats.cells(every))


def test_a_segment_without_its_row_in_the_log_does_not_count(spark, tmp_path):
    path = str(tmp_path / "posts")
    for i in range(3):
        writers.write_batch_posts(posts(spark, i), path, i)
    whole = sorted(map(key, readers.read_posts(spark, path).collect()))
    writers.merge_posts(spark, path, 1)
    assert sorted(map(key, readers.read_posts(spark, path).collect())) == whole and len(whole) == 120
    # A merge that died before its row was written.
    held = Segments(spark, path)
    held.batches(readers.STORED_POST, 1, 2).drop("batch_id").write.parquet(f"{path}/_segments/segment-000000000002-dead")
    assert sorted(map(key, readers.read_posts(spark, path).collect())) == whole
    writers.merge_posts(spark, path, 2)
    writers.merge_posts(spark, path, 2)
    writers.write_batch_posts(posts(spark, 2), path, 2)
    assert sorted(map(key, readers.read_posts(spark, path).collect())) == whole
    assert [row[:2] for row in held.log()] == [(1, 2), (-1, 1)]
    held.clean()
    writers.write_batch_posts(posts(spark, 3), path, 3)
    assert readers.read_posts(spark, path).count() == 160
    assert readers.read_posts(spark, path, "twitter").where("resource <> 'TWITTER'").count() == 0
    days = spark.read.parquet(f"{path}/_segments/{held.log()[1][2]}")
    assert {"day", "resource"} <= set(days.columns)


def test_two_merges_of_the_same_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "posts")
    writers.write_batch_posts(posts(spark, 0), path, 0)
    rows = Segments(spark, path).batches(readers.STORED_POST, -1, 0).drop("batch_id")
    for _ in range(2):
        Segments(spark, path).write(rows, -1, 0, "resource")
    assert readers.read_posts(spark, path).count() == 40


def test_ingest_counts_and_merges_as_it_goes(spark, tmp_path):
    cells, path = CellStore(spark, str(tmp_path / "cells"), merge_every=2), str(tmp_path / "posts")
    for i in range(4):
        posts(spark, i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.start_ingest(stream, lambda df: df, path, str(tmp_path / "state"), available_now=True, cells=cells,
                        merge_every=2).awaitTermination()
    assert readers.read_posts(spark, path).count() == 160 and Segments(spark, path).merged() == 1
    assert counted(cells.cells()) == counted(stats.cells(readers.read_posts(spark, path)))


@pytest.mark.parametrize("parts", [1, 7])
def test_fragments_are_one_document(spark, tmp_path, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        documents = stats.stats_documents(stats.sparse_stats(stats.cells(posts(spark, 9, 300))))
        writers.write_fragments(stats.stats_fragments(documents), str(tmp_path / "nested"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = json.loads("".join(f.read_text() for f in sorted((tmp_path / "nested").glob("part-*"))))
    want: dict = {}
    for r in documents.where("city IS NOT NULL").collect():
        city = want.setdefault(r.resource, {}).setdefault(r.city, {})
        if r.level == "total":
            city["total"] = json.loads(r.stats)
        else:
            city.setdefault(r.level, {})[r.geo] = json.loads(r.stats)
    assert found == want and len(want) == 2 and len(want["TWITTER"]) == 3
    assert stats.stats_fragments(documents.limit(0)).count() == 0


def test_dedupe_on_disk_survives_a_restart_in_the_middle_of_a_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(urls):
        if urls:
            spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(source)
        with ingest.state_on_disk(spark):
            stream = spark.readStream.schema("url string").parquet(source)
            (ingest.dedupe_stream(stream, "url").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
        return Counter(r.url for r in spark.read.parquet(out).collect())

    assert run(["a", "b", "a"]) == {"a": 1, "b": 1}
    assert run(["b", "c", "a"]) == {"a": 1, "b": 1, "c": 1}
    # The last batch was not committed: it is run again on the state before it.
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    assert run([]) == {"a": 1, "b": 1, "c": 1}
    assert run(["late", "c"]) == {"a": 1, "b": 1, "c": 1, "late": 1}
    assert any((tmp_path / "state" / "state").rglob("*.changelog"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
