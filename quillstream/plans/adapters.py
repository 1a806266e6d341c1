"""The driver tables in the roles of the flow's tables; ids are one higher there, since 0 means no id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as K

#: Fixed times, so that queries are deterministic.
NOW_EVENTS, NOW_ORDERS = "2024-01-20 12:00:00", "1996-06-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the delivery log: purchases are publications, clicks comments, signups cooldowns."""
    kinds = F.when(F.col("event_type") == "purchase", "published").when(F.col("event_type") == "click", "comment_posted").when(F.col("event_type") == "signup", "meta_cooldown").otherwise(F.col("event_type"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return table(spark, sf_dir, "events").select(
        kinds.alias("event"), (F.col("user_id") + 1).alias("telegram_id"), F.concat(F.lit("p"), (F.col("event_id") % 997).cast("string")).alias("facebook_post_id"),
        stamp.alias("published_at"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).otherwise("").alias("first_comment"),
        F.when(kinds == "meta_cooldown", stamp).alias("retry_at"), F.col("event_id").alias("ingest_seq"),
    )


def order_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the ready table: priority is attention, the order date is the source date, some texts carry claims."""
    key = F.col("o_orderkey")
    attention = F.when(F.col("o_orderpriority").startswith("1"), "breaking").when(F.col("o_orderpriority").startswith("2"), "warning").when(F.col("o_orderpriority").startswith("3"), "important").otherwise("none")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("breaking_news", "incident", "update", "tool", "general", "vulnerability")]), (key % 6 + 1).cast("int"))
    post = (
        F.when(key % 11 == 0, "The court charged a man.").when(key % 13 == 0, "Pwn2Own results are in.").when(key % 17 == 0, "A breach was disputed.")
        .when(key % 19 == 0, "Posted without any evidence.").when(key % 23 == 0, "").otherwise(F.concat(F.lit("Order "), key.cast("string"), F.lit(" is out.")))
    )
    return table(spark, sf_dir, "orders").select(
        (key + 1).alias("telegram_id"), F.when(F.col("o_orderstatus") == "F", "duplicate").otherwise("ready").alias("status"), F.when(key % 29 == 0, "ar").otherwise("en").alias("language"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("source_published_at"), post.alias("facebook_post"), F.lit("").alias("card_title"),
        F.when(key % 2 == 0, F.concat(F.lit("https://news.example.com/"), key.cast("string"))).otherwise("").alias("source_url"),
        F.struct(attention.alias("attention_label"), kind.alias("content_type")).alias("editorial"), (F.col("o_custkey") % 3).alias("editorial_version"),
        F.col("o_custkey"), (key + 1).alias("ingest_seq"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as stories: the first line is the main fact, all the rest one further fact; names and numbers are those of the whole text."""
    text = F.coalesce("text", F.lit(""))
    rest = F.regexp_replace(text, r"^[^\n]*\n?", "")
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("telegram_id"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("source_published_at"), F.lit("").alias("card_title"), F.lit("").alias("source_url"),
        F.struct(
            F.element_at(F.split(text, "\n"), 1).alias("main_fact"), F.array(rest).alias("supporting_facts"),
            F.array_distinct(K.strict_tokens(text)).alias("protected_entities"), K.all_numbers(text).alias("protected_numbers"),
        ).alias("editorial"), (F.col("doc_id") + 1).alias("ingest_seq"),
    )
