"""The flow's runs as plans: what each reads, decides and appends, without touching a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import dedupe, events, merge, prepare, queue, rights, threads
from ..sources import html, jsonl
from ..sources.sinks import Delivery, comment_events, deliver


def collect(pages: DataFrame, state: DataFrame, now: Column, **channel) -> tuple[DataFrame, DataFrame]:
    """Messages beyond the state's last one, and the state after them."""
    seen = F.broadcast(state.agg(F.max(F.coalesce("last_seen_id", F.lit(0))).alias("seen")))  # one row
    fresh = html.read_messages(pages, now=now, **channel).crossJoin(seen).where(F.col("telegram_id") > F.col("seen")).drop("seen")
    top = fresh.agg(F.max("telegram_id").alias("top"))
    after = state.crossJoin(F.broadcast(top)).select("channel", F.greatest("last_seen_id", "top").alias("last_seen_id"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at"))
    return fresh, after


def items_to_prepare(inbox: DataFrame, ready: DataFrame, log: DataFrame) -> DataFrame:
    """Waiting inbox rows in their normal form, with the messages that they answer."""
    waiting = queue.to_prepare(inbox, ready, log)
    history = inbox.withColumn("text", X.first_filled(F.col("clean_text"), F.col("raw_text")))
    rows = waiting.withColumn("text", X.first_filled(F.col("clean_text"), F.col("raw_text")))
    return prepare.normal_item(threads.reply_context(rows, history, text="text").drop("clean_text", "raw_text"))


def prepared(items: DataFrame, completions: DataFrame, own_fragments: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Checked answers of the items, and those that were rejected with their reasons.

    ``completions`` has an answer text for each item and attempt; the first that
    parses counts.  Items without one are in neither table and stay waiting.
    """
    answers = prepare.first_valid(completions.withColumn("answer", prepare.parse_answer(F.col("response"))))
    rows = items if "primary_evidence" in items.columns else items.withColumn("primary_evidence", F.array().cast(schemas.EVIDENCE))
    checked = prepare.enforce_policy(rows.join(answers, "telegram_id"), own_fragments)
    return checked.where(F.size("reject_reasons") == 0), checked.where(F.size("reject_reasons") > 0).select("telegram_id", "model", "reject_reasons")


def marked_duplicates(ready: DataFrame) -> DataFrame:
    """Ready rows, in order of id, with those that repeat a kept story marked as duplicates."""
    fingered = dedupe.annotate(ready)
    found = dedupe.greedy_duplicates(dedupe.with_story(fingered)).where("duplicate_of is not null")
    named = found.select("telegram_id", F.col("duplicate_of").alias("duplicate_of_telegram_id"), F.col("reason").alias("duplicate_reason"), F.col("score").alias("duplicate_score"))
    plain = fingered.drop("duplicate_of_telegram_id", "duplicate_reason", "duplicate_score")
    return plain.join(named, "telegram_id", "left").withColumn("status", F.when(F.col("duplicate_of_telegram_id").isNotNull(), "duplicate").otherwise(F.col("status")))


def publish(ready: DataFrame, log: DataFrame, remote: DataFrame, adapter: Delivery, now: Column, brand: str, target: int | None = None) -> dict[str, DataFrame]:
    """Log lines of one publishing run: held, duplicate, published.

    Nothing is published while a cooldown lasts or the gap since the last post
    is too short; at most one item goes out.
    """
    gate = events.cooling_until(log, now).crossJoin(F.broadcast(events.last_published(log)))  # one row by one row
    free = gate.where(F.col("cooling_until").isNull() & ~queue.must_wait(now, F.col("last_at"))).select(F.lit(1).alias("free"))
    reasoned = queue.with_reasons(queue.to_publish(ready, log, target=target), log, now)
    first = queue.next_item(reasoned, now).drop("reason").crossJoin(F.broadcast(free)).drop("free")
    out_before = ready.join(events.ids_with(log, ("published",)), "telegram_id", "left_semi")
    repeats = dedupe.best_match(first, out_before)
    story = dedupe.annotate(first)
    fresh = story.join(repeats.select("telegram_id"), "telegram_id", "left_anti")
    kind, attention = F.col("editorial.content_type"), F.col("editorial.attention_label")
    seen = F.concat_ws(" ", *[X.or_empty(F.col(c)) for c in ("title", "card_title", "facebook_post") if c in fresh.columns])
    message = X.delivery_message(F.col("facebook_post"), X.attention_marker(attention, kind), X.hashtags(X.topic(kind, seen), brand), F.col("language") == "en")
    sendable = fresh.withColumn("message", message).where(F.size(X.delivery_rejects(F.col("message"))) == 0)
    skipped = repeats.select(F.lit("duplicate_skipped").alias("event"), "telegram_id", F.col("duplicate_of").alias("duplicate_of_telegram_id"), F.col("reason").alias("duplicate_reason"), F.col("score").alias("duplicate_score"))
    return {"held": events.held_events(reasoned, now), "duplicate": skipped, "published": deliver(sendable, remote, adapter, now)}


def retry_comments(log: DataFrame, adapter: Delivery, now: Column) -> DataFrame:
    """Log lines of comments that could now be posted."""
    return comment_events(events.comments_to_retry(log), adapter, now)


def with_video_rights(items: DataFrame, overrides: DataFrame, channels: DataFrame) -> DataFrame:
    """Items whose film may be used again, and how much of it."""
    return rights.video_rights(items, overrides, channels).where("rights.reupload_allowed")


def merge_folders(spark: SparkSession, ours: str, theirs: str) -> dict[str, DataFrame]:
    """Both copies of the logs and states, merged; ``ours`` is the shared copy."""
    logs = {"inbox": (schemas.INBOX, merge.id_key), "ready": (schemas.READY, merge.id_key), "facebook_events": (schemas.EVENTS, merge.event_key)}
    out = {name: merge.merge_logs(*[jsonl.read_log(spark, f"{d}/{name}.jsonl", schema, objects_only=True) for d in (ours, theirs)], key) for name, (schema, key) in logs.items()}
    both = lambda name, schema: [jsonl.read_state(spark, f"{d}/{name}.json", schema, {}) for d in (ours, theirs)]
    out["state"] = merge.merge_collector_state(*both("state", schemas.COLLECTOR_STATE))
    out["ai_state"] = merge.merge_prepare_state(*both("ai_state", schemas.PREPARE_STATE))
    return out
