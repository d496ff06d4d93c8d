"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bayes import Model
from ..operators.geo import place_index
from ..params import Parameters
from ..plans.posts import to_posts, tweet_items
from ..sources.readers import bad_tweets, good_tweets, parse_tweets, read_batch_posts
from ..sources.segments import Segments
from ..sources.writers import merge_posts, write_batch_posts
from .cells import CellStore


def start_ingest(
    stream: DataFrame,
    to_rows: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "10 seconds",
    on_batch: Callable[[DataFrame, int], None] | None = None,
    cells: CellStore | None = None,
    merge_every: int | None = None,
) -> StreamingQuery:
    """Run ``to_rows`` on every micro-batch and append its posts to ``path``.

    ``cells`` keeps the counts of all batches up to date; ``merge_every`` merges the stored
    posts of so many batches into one segment.

    The lookups inside aggregate, which a stateless stream may do per micro-batch.  A
    batch replayed after a failure overwrites its own partition, so a restart on the same
    checkpoint adds no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # The lookups read the batch several times; its source is read once.
        batch.persist()
        try:
            write_batch_posts(to_rows(batch), path, batch_id)
            if cells:
                # What was stored is counted, so a report never runs ahead of the posts.
                cells.add(read_batch_posts(batch.sparkSession, path, batch_id), batch_id)
            if merge_every and batch_id - Segments(batch.sparkSession, path).merged() > merge_every:
                # All but this batch, which may be replayed.
                merge_posts(batch.sparkSession, path, batch_id - 1)
            if on_batch:
                on_batch(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def start_tweets(
    lines: DataFrame,
    params: Parameters,
    gazetteer: DataFrame,
    continents: DataFrame,
    model: Model | None,
    path: str,
    checkpoint: str,
    quarantine: str | None = None,
    **options,
) -> StreamingQuery:
    """Tweet lines to stored posts; lines that do not parse go to ``quarantine``.

    The place index is built and stored once, before the first batch.
    """
    tweets = parse_tweets(lines)
    index = place_index(gazetteer, continents)

    def to_rows(batch):
        items = tweet_items(good_tweets(batch), params)
        return to_posts(items, "TWITTER", gazetteer, continents, model, stored=True, index=index)

    def keep_bad(batch, batch_id):
        (bad_tweets(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(quarantine))

    return start_ingest(tweets, to_rows, path, checkpoint,
                        on_batch=keep_bad if quarantine else None, **options)


#: Keyed state on the executors' disks, with a log of changes in the checkpoint folder, so that
#: neither memory nor what a batch writes grows with the keys seen.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; the session's settings come back."""
    before = {key: spark.conf.get(key, None) for key in STATE_ON_DISK}
    for key, value in STATE_ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def dedupe_stream(
    stream: DataFrame, key: str, time: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """The first row of each key.

    By default a key is remembered forever, and a row counts however late it comes; start the
    stream within ``state_on_disk``, so that the keys need no memory.  With
    ``time`` a key is remembered for ``delay`` of event time only, which bounds the state at
    a price: rows older than the watermark are lost even if their key is new, and a key may
    come again after the delay.
    """
    if time is None:
        return stream.dropDuplicates([key])
    # A watermark needs a timestamp with time zone.
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
