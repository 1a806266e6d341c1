"""The backward source: whole sweeps, restarts, pages on the way, errors instead of gaps."""

import re

import pytest
from pyspark.sql import functions as F

from quillstream.streaming import backfill, flows


def _page(folder, first, last):
    posts = "".join(f'<div class="m" data-post="chan/{k}"><div class="m_text">text {k}</div><time datetime="2026-10-02T11:00:00+00:00"></time></div>' for k in range(first, last + 1))
    (folder / f"{first}-{last}.html").write_text(posts)


def _numbers(rows):
    """All numbers that the rows stand for, in order and none twice."""
    found = sorted(int(k) for known, top, before, text in rows for k in re.findall(r"chan/(\d+)", text) if known < int(k) <= top)
    assert len(found) == len(set(found))
    return found


def test_sweeps_and_restarts(spark, tmp_path):
    spark.dataSource.register(backfill.BackwardPages)
    pages = tmp_path / "pages"
    pages.mkdir()
    got = []

    def work(batch, _):
        got.extend(r.telegram_id for r in backfill.messages(batch, css="m").collect())

    def once(stop_after=None):
        stream = spark.readStream.format("backward_pages").option("path", str(pages)).option("known", 4).load()
        query = stream.writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()

    for first in (1, 6, 11):
        _page(pages, first, first + 4)
    once()
    assert sorted(got) == list(range(5, 16))
    _page(pages, 14, 20)  # overlaps a page that was read
    _page(pages, 21, 22)
    once()
    once()
    assert sorted(got) == list(range(5, 23))


def test_every_cut_between_batches_is_read_again(tmp_path):
    for first in (1, 6, 11):
        _page(tmp_path, first, first + 4)
    reader = backfill.BackwardReader(backfill.PageFiles(str(tmp_path)), 2, 30)
    at, steps = reader.initialOffset(), []
    while True:
        rows, after = reader.read(at)
        if after == at:
            break
        steps.append((at, after, list(rows)))
        at = after
        if len(steps) == 1:
            _page(tmp_path, 16, 18)  # comes during the sweep: belongs to the next one
    assert [r[2] for s in steps for r in s[2]] == [16, 11, 6, 19]
    assert [(r[0], r[1]) for s in steps for r in s[2]] == [(2, 15)] * 3 + [(15, 18)]
    fresh = backfill.BackwardReader(backfill.PageFiles(str(tmp_path)), 2, 30)
    for i in range(len(steps)):
        for j in range(i, len(steps)):
            again, first = list(fresh.readBetweenOffsets(steps[i][0], steps[j][1])), [r for s in steps[i : j + 1] for r in s[2]]
            assert _numbers(again) == _numbers(first)
            assert i != j or again == first


def test_a_gap_is_an_error(tmp_path):
    for first in (1, 6, 11):
        _page(tmp_path, first, first + 4)
    reader = backfill.BackwardReader(backfill.PageFiles(str(tmp_path)), 0, 2)
    at = reader.initialOffset()
    for _ in range(2):
        _, at = reader.read(at)
    with pytest.raises(ValueError, match="between 0 and 6"):
        reader.read(at)

    class Stuck(backfill.PageFiles):
        def before(self, cursor):
            return cursor, ""

    with pytest.raises(ValueError, match="begins at"):
        backfill.BackwardReader(Stuck(str(tmp_path)), 0, 30).read(reader.initialOffset())
    empty = tmp_path / "empty"
    empty.mkdir()
    reader = backfill.BackwardReader(backfill.PageFiles(str(empty)), 7, 30)
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [] and at == reader.initialOffset()


def test_state_goes_behind_the_watermark(spark, tmp_path):
    day = 86_400
    kinds = ["published", "comment_posted"]
    for part in range(6):  # each file a batch, ten days on, with ids of its own
        rows = [(kinds[k % 2], part * 10 + k // 2, f"p{part}", part * 100 + k, 1_700_000_000 + part * 10 * day + k) for k in range(20)]
        df = spark.createDataFrame(rows, "event string, telegram_id long, facebook_post_id string, ingest_seq long, s long")
        df.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    schema = "event string, telegram_id long, facebook_post_id string, ingest_seq long, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    latest = {}
    writer = flows.delivery_state(stream, keep_days=12).writeStream.outputMode("update").foreachBatch(lambda b, _: latest.update({r.telegram_id: (r.post_id, r.comment_posted) for r in b.collect()}))
    query = writer.option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert latest == {part * 10 + k: (f"p{part}", True) for part in range(6) for k in range(10)}
    assert max(held) <= 40 and held[-1] < 60
