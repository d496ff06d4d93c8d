"""Tables bucketed by a key, for loops that join the same large table again and again."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Buckets:
    """A table under ``path`` whose rows lie in buckets of ``keys``.

    There are as many buckets as a shuffle has partitions, so a join or an aggregation on the
    keys reads the table where it lies, and only the other side moves.  Appends go to folders
    of ``partition``, if there is one, and a filter on it reads these alone.
    """

    spark: SparkSession
    path: str
    keys: Sequence[str]
    partition: str | None = None
    name: str = field(default_factory=lambda: f"buckets_{uuid.uuid4().hex}")

    @property
    def n(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, rows: DataFrame) -> None:
        """Each bucket gets one more file."""
        writer = rows.repartition(self.n, *self.keys).write.mode("append").option("path", self.path)
        if self.partition:
            writer = writer.partitionBy(self.partition)
        writer.bucketBy(self.n, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """Forget the buckets; the rows as a plain table of the folder, which stays."""
        schema = self.read().schema
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)
