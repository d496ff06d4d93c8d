"""Batches of a stream, merged now and then into segments behind a log of commits.

Under ``path`` a stream keeps one folder for each batch (``batch_id=...``), which a replay
overwrites.  A segment holds the batches after one number up to another; it counts once a row
about it is in the log.  Readers take the segments of the last commit backwards and the batches
behind them, so they see a merge whole or not at all, and a batch that is replayed after its
merge is not counted twice.  Segments and log are in folders that a plain read of ``path``
passes over.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path

LOG = "after bigint, upto bigint, folder string"
#: The number before the first batch.
START = -1


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    path: str

    def log(self) -> list[tuple[int, int, str]]:
        """The segments that count, latest first; one row of the log is one merge."""
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.path}/_log").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        by_end: dict[int, tuple[int, int, str]] = {}
        for row in sorted(map(tuple, rows), key=lambda r: r[2]):
            by_end.setdefault(row[1], row)
        chain, end = [], max(by_end, default=START)
        while end != START:
            chain.append(by_end[end])
            end = chain[-1][0]
        return chain

    def merged(self) -> int:
        """The last batch that is in a segment."""
        return max((upto for _, upto, _ in self.log()), default=START)

    def write(self, rows: DataFrame, after: int, upto: int, *partitions: str) -> None:
        """A new segment of the batches after ``after`` up to ``upto``."""
        folder = f"segment-{upto:012d}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partitions).parquet(f"{self.path}/_segments/{folder}")
        self.spark.createDataFrame([(after, upto, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/_log")

    def batches(self, schema: str, after: int, upto: int | None = None) -> DataFrame:
        """Rows of the batches after one number, with their ``batch_id``; folders of others
        are not read."""
        try:
            rows = self.spark.read.schema(f"{schema}, batch_id bigint").parquet(self.path).where(F.col("batch_id") > after)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch_id bigint")
        return rows if upto is None else rows.where(F.col("batch_id") <= upto)

    def rows(self, schema: str) -> DataFrame:
        """All rows: the segments' and those of the batches behind them."""
        log = self.log()
        out = self.batches(schema, max((upto for _, upto, _ in log), default=START)).drop("batch_id")
        for _, _, folder in log:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/_segments/{folder}").select(*out.columns))
        return out

    def clean(self) -> None:
        """Delete the folders of merged batches, for when no older reader is at work."""
        merged = self.merged()
        done = self.spark.read.schema("batch_id bigint").parquet(self.path).where(
            F.col("batch_id") <= merged).select("batch_id").distinct()
        for row in done.collect():
            delete_path(self.spark, f"{self.path}/batch_id={row['batch_id']}")
