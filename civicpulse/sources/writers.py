"""Table writers."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bayes import Model
from .readers import STORED_POST
from .segments import Segments


def append_posts(posts: DataFrame, path: str) -> None:
    posts.write.mode("append").partitionBy("resource").parquet(path)


def append_quarantine(items: DataFrame, path: str) -> None:
    """Items that could not be made posts, as found."""
    items.write.mode("append").parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Label and text as a quoted CSV, in the columns that ``read_corpus`` takes by default."""
    blank = F.lit("")
    corpus.select(blank.alias("c0"), "label", blank.alias("c2"), blank.alias("c3"), "text").write.mode("overwrite").options(
        quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_batch_posts(posts: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent append of one micro-batch: a replay overwrites its own partitions only."""
    (posts.withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "resource").parquet(path))


def merge_posts(spark: SparkSession, path: str, upto: int) -> None:
    """Merge the batches of a post store up to ``upto`` into one segment by day and source.

    The segment has few files of even size: large days are split, small ones put together.
    Replays of merged batches change nothing.
    """
    held = Segments(spark, path)
    merged = held.merged()
    if merged < upto:
        posts = held.batches(STORED_POST, merged, upto).drop("batch_id").withColumn("day", F.to_date("date"))
        held.write(posts.hint("rebalance", "day", "resource"), merged, upto, "day", "resource")


def write_stats(documents: DataFrame, path: str) -> None:
    """Nested stats, one JSON object per line."""
    documents.write.mode("overwrite").json(path)


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Nested stats as text files that, one after the other, are one JSON text."""
    (fragments.repartitionByRange("position").sortWithinPartitions("position")
     .select("fragment").write.mode("overwrite").text(path))


def save_model(model: Model, models_dir: str, data_source: str) -> None:
    """Save a new version: its features in a folder of their own, then one row of metadata.

    The row is appended last and names the folder, so until then the version before loads.
    """
    path, version = f"{models_dir}/{data_source}", f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    spark = model.features.sparkSession
    model.features.write.parquet(f"{path}/features-{version}")
    saved = spark.read.parquet(f"{path}/features-{version}")
    size = saved.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.coalesce(F.sum(F.octet_length("feature")), F.lit(0)).alias("feature_bytes"))
    labels = spark.createDataFrame(
        [(list(model.labels),)], "labels array<struct<label:string,n:bigint>>")
    # Two single rows.
    size.withColumn("one", F.lit(1)).join(labels.withColumn("one", F.lit(1)), "one").drop(
        "one").withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/meta")
