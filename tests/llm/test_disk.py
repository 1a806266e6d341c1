"""Shuffle files on disk: of the step that runs, and of part of the keys at a time."""

import time

from pyspark.sql import functions as F

from quillstream.llm import common, neardup


def test_stored_frees_shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: env.blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = held()
    common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    common.stored(spark.range(1))  # a step's files go with the next step, when nothing refers to them
    end = time.time() + 20
    while held() > before and time.time() < end:
        time.sleep(0.5)
    assert held() <= before


def test_keys_are_dealt_in_parts(spark, monkeypatch):
    """The same rows as when dealt at once, no part with all of them."""
    rows = spark.range(4000).select(F.xxhash64(F.col("id") % 900).alias("key"), F.col("id").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("at"))
    kept, sent = neardup.stored, []
    monkeypatch.setattr(neardup, "stored", lambda df: sent.append(kept(df)) or sent[-1])
    got = sorted(map(tuple, neardup._dealt_in_parts(rows).select("key", "node").collect()))
    assert got == sorted(map(tuple, neardup._dealt(rows).select("key", "node").collect())) and len(got) == 4000
    assert len(sent) == neardup.PARTS and all(0 < t.count() < 2000 for t in sent)
