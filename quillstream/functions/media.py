"""Media rules on metadata columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def media_kind(has_images: Column, has_video: Column, has_document: Column) -> Column:
    return F.when(has_video & has_images, "mixed").when(has_video, "video").when(has_images, "image").when(has_document, "document").otherwise("text")


def image_score(width: Column, height: Column, size: Column, from_channel: Column) -> Column:
    """Area, raised for large, wide, heavy and channel images."""
    ratio = width / F.greatest(height, F.lit(1))
    factor = lambda cond, by: F.when(cond, by).otherwise(1.0)
    return (
        (width * height).cast("double")
        * factor(width >= 1200, 1.35)
        * factor(width >= 1600, 1.15)
        * factor((ratio >= 1.2) & (ratio <= 2.1), 1.18)
        * factor(size >= 120_000, 1.08)
        * factor(from_channel, 1.25)
    )


def image_usable(width: Column, height: Column, size: Column, from_channel: Column) -> Column:
    """Within the limits of its origin in bytes, size and shape."""
    ratio = width / F.greatest(height, F.lit(1))
    channel = (size >= 4_000) & (width >= 240) & (height >= 160)
    page = (size >= 12_000) & (width >= 640) & (height >= 320)
    return (size <= 15 * 1024 * 1024) & ratio.between(0.35, 3.5) & F.when(from_channel, channel).otherwise(page)


def processing_seconds(duration: Column, floor: int = 420, cap: int = 3000) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.floor(F.greatest(F.lit(0.0), duration) * 1.8 + 180).cast("int")))


def clip_seconds(duration: Column, start: Column, most: Column) -> Column:
    """Length of the clip from start, 0.1 s at least, at most what is allowed."""
    rest = F.greatest(F.lit(0.1), duration - F.coalesce(start, F.lit(0.0)))
    return F.when(most.isNotNull(), F.least(rest, most)).otherwise(rest)


def retry_delay(retry_after: Column, attempt: Column) -> Column:
    given = retry_after.try_cast("double")
    return F.when(given.isNotNull(), F.least(F.lit(30.0), F.greatest(F.lit(0.5), given))).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(15.0)))


def variant(key: Column, title: Column) -> Column:
    """Which of four designs: the key's remainder, else that of the title's checksum."""
    return F.coalesce(F.pmod(key.try_cast("bigint"), F.lit(4)), F.pmod(F.crc32(F.coalesce(title, F.lit(""))), F.lit(4))).cast("int")
