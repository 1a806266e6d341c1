"""Stream variants against their batch results."""

from pyspark.sql import functions as F

from quillstream.operators import events
from quillstream.streaming import flows

LOG = "event string, telegram_id long, facebook_post_id string, first_comment string, ingest_seq long, at timestamp"


def _log(spark):
    kinds = ["published", "comment_posted", "published", "other"]
    rows = [(kinds[(k * 7) % 4], k % 5 + 1, f"p{k % 9}", "c", k) for k in range(60)]
    df = spark.createDataFrame(rows, "event string, telegram_id long, facebook_post_id string, first_comment string, ingest_seq long")
    return df.withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("ingest_seq") * 60))


def test_state_stream_equals_batch(spark, tmp_path):
    log = _log(spark)
    log.repartition(6).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log"))
    latest = {}

    def keep(batch, _):
        latest.update({r.telegram_id: (r.post_id, r.comment_posted) for r in batch.collect()})

    query = flows.delivery_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {r.telegram_id: (r.post_id, r.comment_posted) for r in events.delivery_state(log).collect()}
    assert latest == want


def test_distinct_posts_and_append(spark, tmp_path):
    log = _log(spark)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    seen = []
    flows.append_batches(flows.distinct_posts(stream), lambda batch, _: seen.extend(r.facebook_post_id for r in batch.collect()), str(tmp_path / "c"))
    want = {r.facebook_post_id for r in log.where("event = 'published'").collect()}
    assert sorted(seen) == sorted(want)


def test_page_folder_goes_on(spark, tmp_path):
    spark.dataSource.register(flows.PageFolder)
    pages = tmp_path / "pages"
    pages.mkdir()
    got = []

    def once():
        stream = spark.readStream.format("page_folder").option("path", str(pages)).load()
        query = stream.writeStream.foreachBatch(lambda b, _: got.extend(r.page for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()

    (pages / "1.html").write_text("<p>a</p>")
    once()
    (pages / "2.html").write_text("<p>b</p>")
    (pages / "3.html").write_text("<p>c</p>")
    once()
    assert sorted(got) == [1, 2, 3]
