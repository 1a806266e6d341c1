"""Whether a video may be used again: the first rule that applies decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions import urls as U

#: Columns of a rule, all text but the flag.
RULE = ("status", "reupload_allowed", "basis", "license_note", "clip_start_seconds", "max_clip_seconds")


def seconds(c: Column) -> Column:
    """A number, 0 at least; null if it isn't one."""
    value = c.try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def _normal(rule: Column, basis: str, scope: Column) -> Column:
    status = F.lower(X.strip(X.first_filled(rule["status"], F.lit("unknown"))))
    status = F.when(status.isin(*P.RIGHTS_KNOWN), status).otherwise("unknown")
    most = seconds(rule["max_clip_seconds"])
    return F.struct(
        status.alias("status"),
        (status.isin(*P.RIGHTS_ALLOWED) & F.coalesce(rule["reupload_allowed"], F.lit(False))).alias("reupload_allowed"),
        X.first_filled(rule["basis"], F.lit(basis)).alias("basis"),
        scope.alias("scope"),
        X.strip(X.or_empty(rule["license_note"])).alias("license_note"),
        seconds(rule["clip_start_seconds"]).alias("clip_start_seconds"),
        F.when(most != 0, most).alias("max_clip_seconds"),
    )


def video_rights(items: DataFrame, overrides: DataFrame, channels: DataFrame, default_status: str = "unknown", id_col: str = "telegram_id") -> DataFrame:
    """Adds ``rights``: by post, else the item's own metadata, else by channel, else the default, which never allows.

    ``overrides`` has item (text) and the rule's columns, ``channels`` has
    channel and the same; both are hand-kept policy, so Spark may broadcast them.
    """
    rule = F.struct(*RULE)
    item = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    by_item = overrides.select(F.col("item").alias("__item"), rule.alias("__by_item"))
    by_channel = channels.groupBy(F.lower(F.regexp_replace("channel", "^@+", "")).alias("__channel")).agg(F.first(rule).alias("__by_channel"))
    url = F.col("media.telegram_post_url")
    out = items.withColumn("__name", U.channel(url)).withColumn("__key", item)
    out = out.join(by_item, F.col("__key") == F.col("__item"), "left").join(by_channel, (F.col("__name") != "") & (F.lower("__name") == F.col("__channel")), "left")
    own = F.col("media.video_rights")
    default = default_status if default_status in P.RIGHTS_KNOWN else "unknown"
    at_channel = F.concat(F.lit("telegram_channel:@"), F.col("__name"))
    post = F.concat(F.lit("telegram_post:"), F.col("__key"))
    nothing = F.struct(
        F.lit(default).alias("status"), F.lit(False).alias("reupload_allowed"), F.lit("no_explicit_reuse_permission").alias("basis"),
        F.when(F.col("__name") != "", at_channel).otherwise("video_attachment").alias("scope"), F.lit("").alias("license_note"),
        F.lit(None).cast("double").alias("clip_start_seconds"), F.lit(None).cast("double").alias("max_clip_seconds"),
    )
    decided = (
        F.when(F.col("__by_item").isNotNull(), _normal(F.col("__by_item"), "explicit_post_override", post))
        .when(own.isNotNull(), _normal(own, "explicit_inline_metadata", F.concat(F.lit("telegram_post:"), F.when(F.col("__key") == "", "unknown").otherwise(F.col("__key")))))
        .when(F.col("__by_channel").isNotNull(), _normal(F.col("__by_channel"), "explicit_channel_policy", at_channel))
        .otherwise(nothing)
    )
    return out.select(*items.columns, decided.alias("rights"))
