"""Counts that keep up with a stream: cells of each batch, merged now and then.

A batch adds the cells of its posts (counts by source, city, sentiment and geography).  A merge
sums the snapshot before it and the batches since into a new snapshot.  The report reads the
snapshot and the batches behind it, so its cost follows the cells and the latest batches, not
the posts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..sources.segments import START, Segments

KEYS = ("resource", "city", "sentiment", *stats.GEO_COLUMNS)
CELL = ", ".join(f"{k} string" for k in KEYS) + ", n bigint"


@dataclass(frozen=True)
class CellStore:
    """Cells under ``path``; so many batches go into one snapshot."""

    spark: SparkSession
    path: str
    merge_every: int = 100

    @property
    def segments(self) -> Segments:
        return Segments(self.spark, self.path)

    def add(self, posts: DataFrame, batch_id: int) -> None:
        """Count the posts of one batch; the same batch again changes nothing."""
        (stats.cells(posts).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path))
        if batch_id - self.segments.merged() >= self.merge_every:
            self.merge(batch_id)

    def merge(self, upto: int) -> None:
        """A snapshot of all batches up to ``upto``, unless a later one is there."""
        held = self.segments
        merged = held.merged()
        if merged < upto:
            late = held.batches(CELL, merged, upto).drop("batch_id")
            before = [self.spark.read.schema(CELL).parquet(f"{self.path}/_segments/{f}") for _, _, f in held.log()]
            # A snapshot holds all before it, so it follows the start.
            held.write(summed(late.unionByName(before[0]) if before else late), START, upto)

    def cells(self) -> DataFrame:
        return summed(self.segments.rows(CELL))

    def report(self, cities: str | Sequence[str]) -> DataFrame:
        """Zero-filled counts of the asked cities, as of now."""
        return stats.dense_stats(self.cells(), cities)


def summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS).agg(F.sum("n").alias("n"))
