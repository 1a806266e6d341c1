"""The preparation and publishing queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.times import hours, minutes_between, timestamp
from . import events as E
from . import gates
from .merge import latest_version


def prepared_ids(ready: DataFrame, events: DataFrame, wanted: str | None = "en", id_col: str = "telegram_id") -> DataFrame:
    """Ids that need no preparation: done by an event, or in the ready table, also as part of another item.

    Ready rows in another language than wanted count as not prepared.
    """
    kept = ready.where(~((X.or_empty(F.col("status")) == "ready") & (X.or_empty(F.col("language")) != wanted))) if wanted else ready
    ids = F.explode(F.concat(F.array(F.col(id_col)), F.coalesce("telegram_ids", F.array().cast("array<bigint>"))))
    done = events.where(F.col("event").isin(*P.TERMINAL_PREPARE)).select(id_col)
    return done.union(kept.select(ids)).where(F.col(id_col).isNotNull()).distinct()


def to_prepare(inbox: DataFrame, ready: DataFrame, events: DataFrame, wanted: str | None = "en", id_col: str = "telegram_id") -> DataFrame:
    """Inbox rows still to prepare, by id."""
    return inbox.where(F.col(id_col) > 0).join(prepared_ids(ready, events, wanted, id_col), id_col, "left_anti").orderBy(id_col)


def to_publish(ready: DataFrame, events: DataFrame, id_col: str = "telegram_id", target: int | None = None) -> DataFrame:
    """Latest version of each ready item without a final event; target: only that one."""
    pending = latest_version(ready, id_col).where(F.col("status") == "ready").join(E.ids_with(events, P.TERMINAL_PUBLISH, id_col), id_col, "left_anti")
    return pending.where(F.col(id_col) == target) if target is not None else pending


def attention_rank(attention: Column, published: Column, now: Column, aging_hours: float = P.AGING_HOURS) -> Column:
    """0 to 3; items that have waited long count as important at least."""
    rank = F.lit(3)
    for name, value in P.ATTENTION_RANK.items():
        rank = F.when(attention == name, value).otherwise(rank)
    return F.when(published.isNotNull() & (now >= published + hours(aging_hours)), F.least(rank, F.lit(2))).otherwise(rank)


def type_rank(content_type: Column) -> Column:
    rank = F.lit(4)
    for name, value in P.TYPE_RANK.items():
        rank = F.when(content_type == name, value).otherwise(rank)
    return rank


def priority(attention: Column, content_type: Column, published: Column, item: Column, now: Column) -> Column:
    """struct that orders the queue: attention, type, newest first, highest id first."""
    newest = -F.coalesce(F.unix_micros(published), F.lit(0))
    return F.struct(attention_rank(attention, published, now).alias("attention"), type_rank(content_type).alias("type"), newest.alias("newest"), (-F.coalesce(item, F.lit(0))).alias("item"))


def with_reasons(pending: DataFrame, events: DataFrame, now: Column, wanted: str | None = "en", id_col: str = "telegram_id") -> DataFrame:
    """Pending items with the reason that keeps each back (empty: none); the caps are one broadcast row."""
    caps = F.broadcast(E.rolling_counts(events, now, id_col))
    text = F.concat_ws(" ", X.or_empty(F.col("facebook_post")), X.or_empty(F.col("card_title")))
    urls = F.transform("primary_evidence", lambda e: e["url"]) if "primary_evidence" in pending.columns else F.array().cast("array<string>")
    sourced = gates.has_public_source(F.col("source_url"), urls)
    reason = gates.eligibility(F.col("language"), text, sourced, timestamp(F.col("source_published_at")), now, F.col("last_day"), F.col("last_hour"), wanted)
    empty = X.strip(X.or_empty(F.col("facebook_post"))) == ""
    return pending.crossJoin(caps).withColumn("reason", F.when(empty, "missing_editorial_text").otherwise(reason)).drop("last_day", "last_hour")


def next_item(reasoned: DataFrame, now: Column, id_col: str = "telegram_id") -> DataFrame:
    """The first eligible item by priority; a top-1, so nothing is sorted as a whole."""
    key = priority(F.col("editorial.attention_label"), F.col("editorial.content_type"), timestamp(F.col("source_published_at")), F.col(id_col), now)
    return reasoned.where(F.col("reason") == "").orderBy(key).limit(1)


def recommended_time(now: Column, previous: Column, gap_minutes: int = P.MIN_GAP_MINUTES) -> Column:
    """struct publish_at, reason."""
    earliest = previous + F.expr(f"INTERVAL '{gap_minutes}' MINUTE")
    reason = F.when(previous.isNull(), "facebook_bootstrap_publish_when_ready").when(now >= earliest, "minimum_gap_already_satisfied").otherwise("small_gap_between_consecutive_posts")
    return F.struct(F.greatest(now, earliest).alias("publish_at"), reason.alias("reason"))


def must_wait(now: Column, last: Column, gap_minutes: int = P.MIN_GAP_MINUTES) -> Column:
    return F.coalesce(now < last + F.expr(f"INTERVAL '{gap_minutes}' MINUTE"), F.lit(False))


def probe(inbox: DataFrame, ready: DataFrame, events: DataFrame, last_seen: int, latest: int, scheduled: bool = False, id_col: str = "telegram_id") -> DataFrame:
    """One row: whether to run, why, and the first ten ids waiting.

    The steps are looked at in order; each is an anti join whose ten smallest
    ids are taken, so nothing grows with the queues.
    """
    positive = lambda df: df.where(F.col(id_col) > 0).select(id_col)
    steps = [
        ("pending_ai_retry", positive(inbox).join(positive(ready).distinct(), id_col, "left_anti")),
        ("pending_facebook_queue", positive(ready.where(F.col("status") == "ready")).join(E.ids_with(events, P.TERMINAL_PUBLISH, id_col), id_col, "left_anti")),
        ("pending_first_comment_retry", events.where((F.col("event") == "published") & (X.strip(X.or_empty(F.col("first_comment"))) != "")).select(F.coalesce(id_col, F.lit(0)).alias(id_col)).join(E.ids_with(events, ("comment_posted",), id_col), id_col, "left_anti")),
    ]
    found = None
    for number, (reason, ids) in enumerate(steps):
        ten = ids.orderBy(id_col).limit(10).agg(F.array_sort(F.collect_list(id_col)).alias("pending_ids")).select(F.lit(number).alias("step"), F.lit(reason).alias("reason"), "pending_ids")
        found = ten if found is None else found.unionByName(ten)
    first = found.where(F.size("pending_ids") > 0).agg(F.min_by(F.struct("reason", "pending_ids"), "step").alias("first"))
    none = F.array().cast("array<bigint>")
    idle = F.struct(F.when(F.lit(latest > last_seen), "new_telegram_content").otherwise("idle_up_to_date").alias("reason"), none.alias("pending_ids"))
    chosen = F.struct(F.lit("scheduled_full_poll").alias("reason"), none.alias("pending_ids")) if scheduled else F.coalesce(F.col("first"), idle)
    return first.select(chosen.alias("c")).select((F.col("c.reason") != "idle_up_to_date").alias("run"), "c.*", F.lit(last_seen).cast("long").alias("last_seen"), F.lit(latest).cast("long").alias("latest"))


def delivery_metrics(items: DataFrame, now: Column, brand: str, message: str = "message") -> DataFrame:
    """What is recorded of a delivery, as struct ``delivery``."""
    kind, att = X.first_filled(F.col("editorial.content_type")), X.first_filled(F.col("editorial.attention_label"))
    evidence = F.size(F.filter(F.coalesce("primary_evidence", F.array().cast(items.schema["primary_evidence"].dataType)), lambda e: X.strip(X.or_empty(e["url"])) != ""))
    linked = X.strip(X.or_empty(F.col("source_url"))) != ""
    seen = F.concat_ws(" ", *[X.or_empty(F.col(c)) for c in ("title", "card_title", "facebook_post")], X.or_empty(F.col("editorial.main_fact")))
    return items.withColumn(
        "delivery",
        F.struct(
            F.when(kind == "", "general").otherwise(kind).alias("content_type"),
            F.when(att == "", "none").otherwise(att).alias("attention_label"),
            X.hashtags(X.topic(kind, seen), brand).alias("hashtags"),
            X.attention_marker(att, kind).alias("attention_marker"),
            F.length(X.visible(F.col(message))).alias("caption_length"),
            F.size(X.paragraphs(F.col(message))).alias("paragraph_count"),
            minutes_between(now, timestamp(F.col("source_published_at"))).alias("source_age_minutes"),
            F.when(evidence > 0, "linked_primary_excerpt").when(linked, "linked_external_source").otherwise("discovery_attribution_only").alias("verification_tier"),
            evidence.alias("primary_evidence_count"),
            linked.alias("source_link_present"),
        ),
    )
