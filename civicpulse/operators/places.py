"""A stored suffix index of place names: which is the best place whose name contains a text.

A name contains a text exactly if one of its suffixes starts with it.  So the index holds one
row for each distinct suffix, in order, cut into range buckets.  The suffixes that start with
a text are neighbours: they begin in one bucket and end in one.  A lookup reads these two
buckets alone; for the buckets between them it has their best places, which are kept apart.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir

#: Suffixes of a bucket: at least so many, and more where there would be too many buckets.
BUCKET_ROWS, MOST_BUCKETS = 16_384, 4_096
#: Texts that are looked up in one bucket at a time.
PART_KEYS = 100_000
PLACE = "population bigint, geoname_id bigint, geo_city string, geo_country string, geo_continent string"
SUFFIXES, BUCKETS = f"suffix string, {PLACE}, bucket int", f"bucket int, low string, {PLACE}"
COLUMNS = [c.split()[0] for c in PLACE.split(", ")]
# Population and id in one number, so that the maximum runs as a hash aggregate: the
# greatest rank is the greatest population and, among equals, the smallest id.
ID_SPAN = 10**19


def id_span() -> Column:
    return F.lit(str(ID_SPAN)).cast("decimal(20,0)")


def place_rank(population: Column, place_id: Column) -> Column:
    people = F.greatest(F.coalesce(population.try_cast("bigint"), F.lit(0)), F.lit(0))
    return (people.cast("decimal(19,0)") * id_span() + (id_span() - 1 - place_id)).cast("decimal(38,0)")


def rank_to_id(rank: Column) -> Column:
    return (id_span() - 1 - rank % id_span()).cast("bigint")


def rank_to_population(rank: Column) -> Column:
    # Without the rest the division is exact.
    return ((rank - rank % id_span()) / id_span()).cast("bigint")


def by_rank() -> Column:
    """A place as one value, the best one greatest."""
    return F.struct("population", (-F.col("geoname_id")).alias("negative"), *COLUMNS[1:])


def best(population: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in order, most populous and then least id first, and the least positions of
    them in all stretches whose lengths are powers of two."""
    order = np.lexsort((place, -population))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    levels, size = [position], 1
    while 2 * size <= len(position):
        levels.append(np.minimum(levels[-1][:-size], levels[-1][size:]))
        size *= 2
    return order, levels


def least_between(levels: list[np.ndarray], start: int, end: int) -> int:
    """The least position between two places (``start < end``)."""
    level = (end - start).bit_length() - 1
    return int(min(levels[level][start], levels[level][end - (1 << level)]))


@dataclass(frozen=True)
class PlaceIndex:
    """A stored index; any session that sees its folder can look up in it."""

    spark: SparkSession
    path: str

    def suffixes(self, buckets: Iterable[int]) -> DataFrame:
        """The rows of some buckets: a filter on folders, so no other file is opened."""
        stored = self.spark.read.schema(SUFFIXES).parquet(f"{self.path}/suffixes")
        return stored.where(F.col("bucket").isin(sorted(buckets)))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``place_key`` and the columns of its best place; keys that no name contains are absent.

        ``keys`` holds distinct, non-null ``place_key`` values; the empty one is in no name.
        """
        where = f"{run_dir(self.spark, 'spots')}/spots"
        spots(keys, self.buckets()).write.parquet(where)
        found = self.spark.read.schema(f"place_key string, bucket int, {PLACE}").parquet(where)
        within = found.where("bucket IS NOT NULL").select("place_key", "bucket")
        # One row for each bucket that is read, so at most MOST_BUCKETS.
        counts = within.groupBy("bucket").count().collect()
        parts = self.spark.createDataFrame(
            [(r["bucket"], ceil(r["count"] / PART_KEYS)) for r in counts], "bucket int, parts int")
        read = self.suffixes(r["bucket"] for r in counts).join(F.broadcast(parts), "bucket").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        asked = within.join(F.broadcast(parts), "bucket").withColumn(
            "part", F.pmod(F.xxhash64("place_key"), "parts").cast("int")).drop("parts")
        hits = asked.groupBy("bucket", "part").cogroup(read.groupBy("bucket", "part")).applyInArrow(
            searched, f"place_key string, {PLACE}")
        every = hits.unionByName(found.where("bucket IS NULL").drop("bucket"))
        return every.groupBy("place_key").agg(F.max(by_rank()).alias("best")).select(
            "place_key", *[f"best.{c}" for c in COLUMNS])

    def buckets(self) -> pa.Table:
        """The first suffix and the best place of each bucket: at most ``MOST_BUCKETS`` rows."""
        return self.spark.read.schema(BUCKETS).parquet(f"{self.path}/buckets").orderBy("bucket").toArrow()


def spots(keys: DataFrame, buckets: pa.Table) -> DataFrame:
    """The buckets in which each key's suffixes begin and end, and, with a null bucket, the
    best place of the buckets in between."""
    lows = [x.encode() for x in buckets["low"].to_pylist()]
    places, numbers = buckets.select(COLUMNS), buckets["bucket"].to_pylist()
    order, levels = best(*(np.asarray(buckets[c], np.int64) for c in COLUMNS[:2]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, between, rows = [], [], [], []
            for key in batch.column(0).to_pylist():
                if not key or not lows:
                    continue
                raw = key.encode()
                # 0xff is in no UTF-8 text: what starts with the key is below.
                first, last = max(0, bisect_right(lows, raw) - 1), bisect_left(lows, raw + b"\xff") - 1
                if last < 0:
                    continue
                ends = {first, last}
                texts += [key] * len(ends)
                at += [numbers[i] for i in sorted(ends)]
                if last - first > 1:
                    between.append(key)
                    rows.append(int(order[least_between(levels, first + 1, last)]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(at, pa.int32()), *[pa.nulls(len(texts), k) for k in kinds]],
                names=["place_key", "bucket", *COLUMNS])
            if between:
                taken = places.take(rows).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(between, pa.string()), pa.nulls(len(between), pa.int32()),
                     *[taken[c].combine_chunks().cast(k) for c, k in zip(COLUMNS, kinds)]], names=["place_key", "bucket", *COLUMNS])

    return keys.select("place_key").mapInArrow(work, f"place_key string, bucket int, {PLACE}")


def searched(asked: pa.Table, bucket: pa.Table) -> pa.Table:
    """The best place for each key that some suffix of the bucket starts with."""
    bucket = bucket.take(np.argsort(np.array([x.encode() for x in bucket["suffix"].to_pylist()], object), kind="stable"))
    suffixes = [x.encode() for x in bucket["suffix"].to_pylist()]
    order, levels = best(*(np.asarray(bucket[c], np.int64) for c in COLUMNS[:2]))
    keys, rows = [], []
    for key in asked["place_key"].to_pylist():
        raw = key.encode()
        start, end = bisect_left(suffixes, raw), bisect_left(suffixes, raw + b"\xff")
        if start < end:
            keys.append(key)
            rows.append(int(order[least_between(levels, start, end)]))
    taken = bucket.select(COLUMNS).take(pa.array(rows, pa.int64()))
    return taken.add_column(0, "place_key", pa.array(keys, pa.string()))


def build_index(gazetteer: DataFrame, places: DataFrame, path: str) -> PlaceIndex:
    """Write the index of a gazetteer's names, with the geography of ``places``
    (geoname_id, geo_city, geo_country, geo_continent).

    A name has as many rows as characters.  A suffix of many names is reduced to its best
    place before it moves.
    """
    spark = gazetteer.sparkSession
    names = gazetteer.select(
        F.lower("name").alias("name"), place_rank(F.col("population"), F.col("geoname_id")).alias("rank")).where(
        "name <> '' AND rank IS NOT NULL").groupBy("name").agg(F.max("rank").alias("rank"))
    cut = names.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("name")))).select(
        F.expr("substring(name, start)").alias("suffix"), "rank")
    top = cut.groupBy("suffix").agg(F.max("rank").alias("rank")).select(
        "suffix", rank_to_population(F.col("rank")).alias("population"), rank_to_id(F.col("rank")).alias("geoname_id"))
    top.join(places, "geoname_id").select("suffix", *COLUMNS).write.parquet(f"{path}/unsorted")
    rows = spark.read.parquet(f"{path}/unsorted")
    n = rows.count()
    buckets = max(1, ceil(n / max(BUCKET_ROWS, ceil(n / MOST_BUCKETS))))
    (rows.repartitionByRange(buckets, "suffix").withColumn("bucket", F.spark_partition_id())
     .sortWithinPartitions("bucket", "suffix").write.partitionBy("bucket").parquet(f"{path}/suffixes"))
    stored = spark.read.schema(SUFFIXES).parquet(f"{path}/suffixes")
    stored.groupBy("bucket").agg(F.min("suffix").alias("low"), F.max(by_rank()).alias("best")).select(
        "bucket", "low", *[f"best.{c}" for c in COLUMNS]).write.parquet(f"{path}/buckets")
    return PlaceIndex(spark, path)
