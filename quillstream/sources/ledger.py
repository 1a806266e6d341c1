"""Deliveries that may be repeated safely: a ledger keyed by batch and item.

What a batch is about to send is written before the sink is called and what the
sink acknowledged after it, each as one Parquet folder that Spark commits as a
whole.  A batch that died in between finds its intents when it runs again: it
sends the same items, but first asks the sink's listing which of them are there.
A batch that was acknowledged is never sent again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from .sinks import Delivery

INTENTS, DONE = "intents", "done"


class DeliveryDeferred(RuntimeError):
    """Whether earlier intents were sent can't be told now; the batch has to run again later."""


class Ledger:
    """Folders of intents and acknowledged posts by batch under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _there(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def read(self, kind: str, batch: int) -> DataFrame | None:
        """What is committed for a batch; None if nothing is."""
        path = self._path(kind, batch)
        return self.spark.read.parquet(path) if self._there(path) else None

    def write(self, kind: str, batch: int, rows: DataFrame) -> DataFrame:
        """Commits a batch's rows; leftovers of a writer that died are replaced."""
        rows.write.mode("overwrite").parquet(self._path(kind, batch))
        return self.read(kind, batch)

    def events(self, schema: str) -> DataFrame:
        """The log lines of all acknowledged batches; of an item that two batches sent, the earlier batch's."""
        if not self._any():
            return self.spark.createDataFrame([], schema + ", batch bigint")
        found = self.spark.read.option("basePath", f"{self.folder}/{DONE}").parquet(f"{self.folder}/{DONE}/batch=*").withColumn("batch", F.col("batch").cast("long"))
        first = found.groupBy("telegram_id").agg(F.min("batch").alias("batch"))
        return found.join(first, ["telegram_id", "batch"], "left_semi")

    def _any(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{DONE}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def deliver_once(rows: DataFrame, batch: int, ledger: Ledger, remote: DataFrame | None, adapter: Delivery, now: Column) -> DataFrame:
    """The log lines of a batch, sent at most once each however often the batch runs.

    ``rows`` has telegram_id, message and the columns of published_event;
    ``remote`` is the sink's bounded listing (post_id, message, rank), None if it
    couldn't be read.  A batch with intents but no acknowledgement is sent again
    from its intents, not from rows, without what the listing has; without a
    listing it is deferred.  The adapter sees delivery_key, the same for every
    try of an item in a batch, for sinks that refuse a repeated key.
    """
    done = ledger.read(DONE, batch)
    if done is not None:
        return done
    meant = ledger.read(INTENTS, batch)
    if remote is None:
        # an unreadable listing proves nothing about what was sent before
        raise DeliveryDeferred(f"batch {batch}: the listing of what was sent can't be read")
    if meant is None:
        key = F.sha2(F.concat_ws(":", F.lit(batch).cast("string"), F.col("telegram_id").cast("string")), 256)
        meant = ledger.write(INTENTS, batch, rows.dropDuplicates(["telegram_id"]).withColumn("delivery_key", key))
    there = E.match_remote(meant, remote).withColumns({"post_id": F.col("remote_post_id"), "media_mode": F.lit("recovered")}).drop("remote_post_id")
    fresh = meant.join(there.select("telegram_id"), "telegram_id", "left_anti")
    sent = adapter.post(fresh).where("post_id is not null")
    return ledger.write(DONE, batch, E.published_event(sent.unionByName(there.select(sent.columns)), now))
