"""Folds over the delivery log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import or_empty, strip
from ..functions.times import hours, timestamp


def ids_with(events: DataFrame, kinds: tuple[str, ...], id_col: str = "telegram_id") -> DataFrame:
    """Distinct positive ids that have an event of these kinds."""
    return events.where(F.col("event").isin(*kinds) & (F.col(id_col) > 0)).select(id_col).distinct()


def delivery_state(events: DataFrame, id_col: str = "telegram_id", seq: str = "ingest_seq") -> DataFrame:
    """Per id the latest publication, and whether a comment followed it.

    A comment counts only after the publication it belongs to: a later
    publication of the same id starts again without one.  One aggregation.
    """
    published = (F.col("event") == "published") & (F.col(id_col) != 0)
    commented = F.col("event") == "comment_posted"
    folded = events.where(published | commented).groupBy(id_col).agg(
        F.max(F.when(published, F.col(seq))).alias("published_seq"),
        F.max(F.when(commented, F.col(seq))).alias("comment_seq"),
        F.max_by(F.struct("facebook_post_id", "first_comment"), F.when(published, F.col(seq))).alias("last"),
    )
    return folded.where("published_seq is not null").select(
        id_col, F.col("last.facebook_post_id").alias("post_id"), or_empty(F.col("last.first_comment")).alias("comment"), F.coalesce(F.col("comment_seq") > F.col("published_seq"), F.lit(False)).alias("comment_posted")
    )


def last_published(events: DataFrame, id_col: str = "telegram_id") -> DataFrame:
    """One row: the time of the latest publication, null if there is none."""
    return events.where((F.col("event") == "published") & (F.col(id_col) != 0)).agg(F.max(timestamp(F.col("published_at"))).alias("last_at"))


def comments_to_retry(events: DataFrame, id_col: str = "telegram_id", seq: str = "ingest_seq") -> DataFrame:
    """Publications that have a first comment to post and none posted, by id."""
    return delivery_state(events, id_col, seq).where((strip(F.col("comment")) != "") & ~F.col("comment_posted")).orderBy(id_col)


def rolling_counts(events: DataFrame, now: Column, id_col: str = "telegram_id", seq: str = "ingest_seq") -> DataFrame:
    """One row: distinct posts of the last 24 hours and of the last hour.

    A post is told by its post id, else its item id; its last line decides its
    time.  The lower bounds are exclusive and times to come count.
    """
    at = timestamp(F.col("published_at"))
    recent = events.where(F.col("event") == "published").withColumn("__at", at).where(F.col("__at") > now - hours(24))
    name = F.coalesce(F.when(F.col("facebook_post_id") != "", F.col("facebook_post_id")), F.col(id_col).cast("string"))
    each = recent.groupBy(name.alias("post")).agg(F.max_by("__at", seq).alias("at"))
    return each.agg(F.count("*").alias("last_day"), F.count_if(F.col("at") > now - hours(1)).alias("last_hour"))


def cooling_until(events: DataFrame, now: Column) -> DataFrame:
    """One row: the latest retry time still to come, null if none is."""
    at = timestamp(F.col("retry_at"))
    return events.where((F.col("event") == "meta_cooldown") & (at > now)).agg(F.max(at).alias("cooling_until"))


def match_remote(messages: DataFrame, remote: DataFrame, message: str = "message", remote_message: str = "message") -> DataFrame:
    """Messages that a remote post already carries, in comparison form, with the first such post's id.

    ``remote`` has post_id, a message column and rank (order of the listing); it
    is a bounded listing of at most a hundred posts.
    """
    from ..functions.text import delivery_form

    theirs = remote.select(delivery_form(F.col(remote_message)).alias("__form"), "post_id", "rank").groupBy("__form").agg(F.min_by("post_id", "rank").alias("remote_post_id"))
    return messages.withColumn("__form", delivery_form(F.col(message))).where(F.col("__form") != "").join(theirs, "__form").drop("__form")


def published_event(rows: DataFrame, now: Column) -> DataFrame:
    """Log lines for posts that a sink acknowledged (post_id, media_mode), with delivery, media_errors and media_diagnostics where rows have them."""
    more = [c for c in ("delivery", "media_errors", "media_diagnostics") if c in rows.columns]
    return rows.select(
        F.lit("published").alias("event"), "telegram_id", F.col("post_id").alias("facebook_post_id"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_at"),
        "first_comment", "source_url", "media_mode", "story_fingerprint", *more,
    )


def held_events(reasons: DataFrame, now: Column, id_col: str = "telegram_id") -> DataFrame:
    """Log lines for items that a final reason takes out of the queue."""
    final = reasons.where(F.col("reason").isin(*P.HELD_REASONS))
    return final.select(F.when(F.col("reason") == "stale_source", "expired").otherwise("editorial_hold").alias("event"), id_col, "reason", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("held_at"))
