"""Whole runs over small folders and tables."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.plans import runs
from quillstream.sources.sinks import Recorder

NOW = datetime(2026, 10, 2, 12, tzinfo=timezone.utc)


def now():
    return F.lit(NOW.isoformat()).cast("timestamp")


def ago(**x):
    return (NOW - timedelta(**x)).isoformat()


READY = (
    "telegram_id long, status string, language string, editorial_version long, source_published_at string, facebook_post string, card_title string, title string, first_comment string, source_url string,"
    "primary_evidence array<struct<url:string,title:string,text:string,retrieved_at:string,kind:string>>,"
    "editorial struct<content_type:string,attention_label:string,main_fact:string,supporting_facts:array<string>,protected_entities:array<string>,protected_numbers:array<string>>, ingest_seq long"
)
EVENTS = "event string, telegram_id long, facebook_post_id string, published_at string, first_comment string, retry_at string, ingest_seq long"


def ready(spark, *rows):
    full = [(k, "ready", "en", 2, at, post, "", "", "Source: x", "https://s.example/" + str(k), [], ("general", att, fact, [], [], []), k) for k, at, post, att, fact in rows]
    return spark.createDataFrame(full, READY)


def remote(spark):
    return spark.createDataFrame([], "post_id string, message string, rank long")


def test_publish(spark):
    rows = ready(
        spark, (1, ago(hours=30), "Old.", "none", "old"), (2, ago(hours=2), "A plain post.", "none", "one plain story of today"),
        (3, ago(hours=1), "Urgent post.", "breaking", "some urgent story of today"), (4, ago(hours=1), "The court charged him.", "none", "x"),
    )
    rows = rows.withColumn("source_url", F.when(F.col("telegram_id") == 4, "").otherwise(F.col("source_url")))
    log = spark.createDataFrame([], EVENTS)
    out = runs.publish(rows, log, remote(spark), Recorder(), now(), "#Brand")
    assert {(r.event, r.telegram_id, r.reason) for r in out["held"].collect()} == {("expired", 1, "stale_source"), ("editorial_hold", 4, "sensitive_claim_without_source")}
    assert [(r.event, r.telegram_id, r.facebook_post_id) for r in out["published"].collect()] == [("published", 3, "recorded-3")]
    cooling = spark.createDataFrame([("meta_cooldown", None, None, None, None, ago(minutes=-5), 1)], EVENTS)
    assert runs.publish(rows, cooling, remote(spark), Recorder(), now(), "#B")["published"].count() == 0
    soon = spark.createDataFrame([("published", 9, "p9", ago(minutes=10), "", None, 1)], EVENTS)
    assert runs.publish(rows, soon, remote(spark), Recorder(), now(), "#B")["published"].count() == 0
    again = ready(spark, (7, ago(hours=3), "Said before.", "none", "some urgent story of today"), (3, ago(hours=1), "Urgent post.", "breaking", "some urgent story of today"))
    later = spark.createDataFrame([("published", 7, "p7", ago(hours=2), "hi", None, 1)], EVENTS)
    out = runs.publish(again, later, remote(spark), Recorder(), now(), "#B")
    assert out["published"].count() == 0
    assert [(r.telegram_id, r.duplicate_of_telegram_id) for r in out["duplicate"].collect()] == [(3, 7)]
    assert [r.telegram_id for r in runs.retry_comments(later, Recorder(), now()).collect()] == [7]


def test_marked_duplicates(spark):
    rows = ready(spark, (1, ago(hours=3), "a", "none", "vendor patches router flaw found worldwide"), (2, ago(hours=2), "b", "none", "vendor patches router flaw found worldwide"), (3, ago(hours=1), "c", "none", "another story altogether about banks"))
    out = {r.telegram_id: (r.status, r.duplicate_of_telegram_id) for r in runs.marked_duplicates(rows).collect()}
    assert out == {1: ("ready", None), 2: ("duplicate", 1), 3: ("ready", None)}


def test_merge_folders(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d, ids, seen in ((a, (10, 11), 20), (b, (10, 12), 21)):
        d.mkdir()
        (d / "inbox.jsonl").write_text("".join(json.dumps({"telegram_id": k}) + "\n" for k in ids))
        (d / "state.json").write_text(json.dumps({"channel": "c", "last_seen_id": seen, "updated_at": "x"}))
        (d / "ai_state.json").write_text(json.dumps({"last_processed_id": seen, "processed_count": 71 - seen, "updated_at": "x"}))
    out = runs.merge_folders(spark, str(a), str(b))
    assert [r.telegram_id for r in out["inbox"].orderBy("position").collect()] == [10, 11, 12]
    assert out["facebook_events"].count() == 0 and out["state"].first().last_seen_id == 21
    assert tuple(out["ai_state"].first())[:2] == (21, 51)


def test_prepare(spark):
    fields = {f.name: None for f in schemas.INBOX.fields}
    rows = [fields | {"telegram_id": 1, "clean_text": "Vendor fixed 2 flaws\nSource: Ann", "source_links": ["https://s.example/a"]}, fields | {"telegram_id": 2, "reply_to_id": 1, "raw_text": "More soon", "source_links": []}]
    inbox = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.INBOX).withColumn("ingest_seq", F.col("telegram_id"))
    empty = spark.createDataFrame([], READY).withColumn("telegram_ids", F.lit(None).cast("array<bigint>"))
    items = runs.items_to_prepare(inbox, empty, spark.createDataFrame([], EVENTS))
    two = {r.telegram_id: r for r in items.collect()}
    assert two[1].text == "Vendor fixed 2 flaws" and two[1].source_note == "Ann" and [c.telegram_id for c in two[2].reply_context] == [1]
    answer = {n: "" for n in schemas.ANSWER_TEXTS} | {n: [] for n in schemas.ANSWER_ARRAYS} | {"language": "en", "certainty": "confirmed"}
    good = json.dumps(answer | {"facebook_post": "The vendor said it fixed 2 flaws."})
    bad = json.dumps(answer | {"facebook_post": "It fixed 9 flaws, he said."})
    done = spark.createDataFrame([(1, 1, "m", "nonsense"), (1, 2, "m", good), (2, 1, "m", bad)], schemas.COMPLETIONS)
    ok, rejected = runs.prepared(items, done)
    assert [(r.telegram_id, r.facebook_post) for r in ok.collect()] == [(1, "The vendor said it fixed 2 flaws.")]
    assert [(r.telegram_id, r.reject_reasons[0]) for r in rejected.collect()] == [(2, "numbers_invented")]
