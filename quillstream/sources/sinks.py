"""Delivery adapters: the engine decides what goes out, an adapter sends it."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import events as E


class Delivery(Protocol):
    """What an adapter does: returns the rows with post_id and media_mode (null post_id: not sent)."""

    def post(self, rows: DataFrame) -> DataFrame: ...

    def comment(self, rows: DataFrame) -> DataFrame: ...


class Recorder:
    """Sends nothing; every row is acknowledged under a name made from its id."""

    def post(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"post_id": F.concat(F.lit("recorded-"), F.col("telegram_id").cast("string")), "media_mode": F.lit("text")})

    def comment(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("comment_id", F.concat(F.lit("recorded-comment-"), F.col("telegram_id").cast("string")))


def deliver(rows: DataFrame, remote: DataFrame, adapter: Delivery, now: Column) -> DataFrame:
    """Log lines of what was sent; what a remote post already carries is recorded, not sent again.

    ``rows`` has message, ``remote`` the bounded listing that match_remote takes.
    """
    there = E.match_remote(rows, remote).withColumns({"post_id": F.col("remote_post_id"), "media_mode": F.lit("recovered")}).drop("remote_post_id")
    fresh = rows.join(there.select("telegram_id"), "telegram_id", "left_anti")
    sent = adapter.post(fresh).where("post_id is not null")
    return E.published_event(sent.unionByName(there.select(sent.columns)), now)


def comment_events(rows: DataFrame, adapter: Delivery, now: Column) -> DataFrame:
    """Log lines of comments that were acknowledged; the others stay for a later run."""
    sent = adapter.comment(rows).where(F.coalesce("comment_id", F.lit("")) != "")
    return sent.select(F.lit("comment_posted").alias("event"), "telegram_id", "comment_id", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("comment_posted_at"))
