"""Row types of the flow's tables.

Every table also carries ``ingest_seq`` (long): the order of lines in a log
decides who wins, and a DataFrame doesn't keep it.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()
_LIST = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MEDIA = _struct(
    has_image=_B, image_url=_S, image_urls=_LIST, has_video=_B, video_url=_S, video_urls=_LIST, video_thumbnail_urls=_LIST,
    has_document=_B, media_type=_S, telegram_post_url=_S,
    video_rights=_struct(status=_S, reupload_allowed=_B, basis=_S, license_note=_S, clip_start_seconds=_S, max_clip_seconds=_S),
)
EDITORIAL = _struct(
    content_type=_S, attention_label=_S, attention_evidence=_S, certainty=_S, main_fact=_S, supporting_facts=_LIST, protected_entities=_LIST, protected_numbers=_LIST,
)
EVIDENCE = T.ArrayType(_struct(url=_S, title=_S, text=_S, retrieved_at=_S, kind=_S))

INBOX = _struct(
    telegram_id=_L, published_at=_S, reply_to_id=_L, collected_at=_S, raw_text=_S, clean_text=_S, all_links=_LIST, source_links=_LIST,
    has_image=_B, image_url=_S, image_urls=_LIST, has_video=_B, video_url=_S, video_urls=_LIST, video_thumbnail_urls=_LIST,
    has_document=_B, media_type=_S, telegram_post_url=_S, status=_S,
)
READY = _struct(
    telegram_id=_L, telegram_ids=T.ArrayType(_L), source_published_at=_S, prepared_at=_S, status=_S, language=_S, editorial_version=_L,
    primary_evidence=EVIDENCE, title=_S, facebook_post=_S, first_comment=_S, source_url=_S, card_title=_S, link_role=_S,
    editorial=EDITORIAL, media=MEDIA, ai_model=_S, story_fingerprint=_S, story_fingerprint_version=_L,
    duplicate_of_telegram_id=_L, duplicate_reason=_S, duplicate_score=_D,
)
EVENTS = _struct(
    event=_S, telegram_id=_L, facebook_post_id=_S, published_at=_S, first_comment=_S, comment_id=_S, comment_posted_at=_S, media_mode=_S,
    source_url=_S, story_fingerprint=_S, retry_at=_S, recorded_at=_S, reason=_S, held_at=_S,
    duplicate_of_telegram_id=_L, duplicate_reason=_S, duplicate_score=_D, skipped_at=_S,
)
COLLECTOR_STATE = _struct(channel=_S, last_seen_id=_L, updated_at=_S)
PREPARE_STATE = _struct(last_processed_id=_L, processed_count=_L, updated_at=_S)
COMPLETIONS = _struct(telegram_id=_L, attempt=_L, model=_S, response=_S)

#: What a generated answer must hold; the arrays are coerced, the rest become text.
ANSWER_ARRAYS = ("supporting_facts", "protected_entities", "protected_numbers")
ANSWER_TEXTS = (
    "language", "content_type", "attention_label", "attention_evidence", "certainty", "main_fact", "title", "facebook_post", "card_title", "link_role", "source_url", "first_comment",
)
