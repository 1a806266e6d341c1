"""Pictures, answers and deliveries: what comes from outside and goes there."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import attempts
from quillstream.sources import ledger, pictures


def now():
    return F.lit("2026-10-02T12:00:00+00:00").cast("timestamp")


def test_structured_pictures():
    data = {"image": ["a", ["never", {"image": "never"}], {"image": "b", "x": [["no", {"thumbnailUrl": "c"}]]}, 5], "y": {"contentUrl": {"contentUrl": "d"}}, "name": "no", "thumbnailUrl": None}
    assert pictures.structured_pictures(data) == ["a", "b", "c", "d"]
    assert pictures.structured_pictures("alone") == [] and pictures.structured_pictures([["x"], 3]) == []
    deep: object = {"image": "end"}
    for _ in range(5000):
        deep = {"x": [deep]}
    assert pictures.structured_pictures(deep) == ["end"]


PAGE = """<html><head><link rel="shortcut image_src" href="/l.jpg"><meta property="og:image" content="/og.jpg?a=1&amp;b=2"><meta name="twitter:image" content=""></head>
<body><img src="/outside.jpg"><div class="post entry-content"><img src="b.jpg" srcset="b2.jpg 2x, b-9.jpg 900w , b-30.jpg 3000w" data-lazy-src="/pixel.gif"><figure><img src="ftp://x/y.jpg"><img src="/og.jpg?a=1&b=2"></figure></div>
<script type="application/ld+json">{"image": broken</script><script type="application/ld+json">{"image": {"contentUrl": "//cdn.example/s.jpg"}}</script></body>"""


def test_ranked_candidates(spark):
    df = spark.createDataFrame([("https://h.example/a/p.html", PAGE), ("https://h.example/", None), (None, "<article><img src='http://ok.example/i.png'></article>")], "url string, html string")
    listed = lambda d: d.withColumn("all", pictures.offered(F.col("url"), F.col("html"))).select("url", pictures.candidates(F.col("all")).alias("c")).collect()
    rows = listed(df)
    want = ["https://h.example/og.jpg?a=1&b=2", "https://h.example/l.jpg", "https://cdn.example/s.jpg", "https://h.example/a/b-30.jpg", "https://h.example/a/b-9.jpg", "https://h.example/a/b2.jpg", "https://h.example/a/b.jpg"]
    assert [x.url for x in rows[0].c] == want
    assert [x.origin for x in rows[0].c] == ["head", "head", "structured", "body", "body", "body", "body"]
    assert rows[1].c == [] and [x.url for x in rows[2].c] == ["http://ok.example/i.png"]
    many = "<article>" + "".join(f"<img src='/{k}.jpg'>" for k in range(99))
    assert len(listed(spark.createDataFrame([("https://h.example/", many)], "url string, html string"))[0].c) == 30


def test_message_pictures(spark):
    page = """<div class="tgme_widget_message_photo_wrap" style="background-image: url('/one.jpg')"><img src="https://x.example/two.jpg"><img src="data:image/png;x"></div><div class="tgme_widget_message_service_photo"><img src="/one.jpg"></div>"""
    df = spark.createDataFrame([("https://t.example/c/5", page), ("https://t.example/", None)], "url string, html string")
    assert [r[0] for r in df.select(pictures.message_pictures(F.col("url"), F.col("html"))).collect()] == [["https://t.example/one.jpg", "https://x.example/two.jpg"], []]


def test_resolved_pictures(spark):
    posts = spark.createDataFrame([(1, ["c1", "c2", "gone"], "https://p.example/"), (2, [], "https://p.example/"), (3, ["tiny"], "https://p.example/"), (4, None, ""), (5, [], "https://q.example/")], "telegram_id long, image_urls array<string>, source_url string")
    pages = spark.createDataFrame([("https://p.example/", "<article><img src='/a.jpg'><img src='/b.jpg'><img src='/c.jpg'>")], "url string, html string")
    fetched = [("c1", 300, 300, 5000), ("c2", 1300, 900, 90_000), ("tiny", 20, 20, 90_000), ("https://p.example/a.jpg", 700, 400, 20_000), ("https://p.example/b.jpg", 1700, 900, 20_000), ("https://p.example/c.jpg", 1700, 900, 20_000)]
    out = {r.telegram_id: r for r in pictures.resolve_pictures(posts, pages, spark.createDataFrame(fetched, "url string, width long, height long, size long")).collect()}
    assert [x.url for x in out[1].selected] == ["c2", "c1"] and not out[1].source_fallback_used and out[1].channel_candidates == 3
    for k in (2, 3):
        assert [(x.origin, x.url) for x in out[k].selected] == [("source", "https://p.example/b.jpg")] and out[k].source_fallback_used and out[k].source_candidates == 3
    assert out[4].selected == [] and not out[4].source_fallback_used
    assert out[5].selected == [] and out[5].source_fallback_used and out[5].source_candidates == 0


TRY = "telegram_id long, place long, model string, error string, data string"


def test_answers_in_order(spark):
    tries = [
        (1, 0, "a", "timeout", None), (1, 1, "b", None, "B"), (1, 2, "c", "", "C"),
        (2, 0, "a", "numbers_omitted", None), (2, 1, "b", "", "B"),
        (3, 0, "a", "entities_changed, invented_transliteration", None), (3, 1, "b", "title_jargon", None), (3, 2, "c", "x", None),
        (4, 0, "a", "", "A"), (4, 1, "b", "numbers_omitted", None),
    ]
    df = spark.createDataFrame(tries, TRY)
    wanted = {(r.telegram_id, r.place, r.repair, r.hint) for r in attempts.repairs_wanted(df).collect()}
    assert wanted == {(2, 0, "fidelity", "numbers_omitted"), (3, 0, "fidelity", "entities_changed, invented_transliteration"), (3, 1, "reader", "title_jargon")}
    repairs = spark.createDataFrame([(2, 0, "", "A2"), (3, 0, "again", None), (3, 1, "worse", None), (1, 0, "", "not asked for")], "telegram_id long, place long, error string, data string")
    out = {r.telegram_id: (r.model, r.data, r.repair, r.failures, r.errors) for r in attempts.choose_answers(df, repairs).collect()}
    assert out[1] == ("b", "B", "", 1, None)
    assert out[2] == ("a", "A2", "fidelity", 0, None)
    assert out[3] == (None, None, "", 3, ["a: entities_changed, invented_transliteration | repair: again", "b: title_jargon | repair: worse", "c: x"])
    assert out[4] == ("a", "A", "", 0, None)


ROW = "telegram_id long, message string, first_comment string, source_url string, story_fingerprint string, delivery struct<content_type:string>, media_errors array<string>"


class Sink:
    """A site in memory: takes posts one by one and may die after some of them."""

    def __init__(self, spark, dies_after=None):
        self.spark, self.posts, self.dies_after = spark, [], dies_after

    def post(self, rows):
        kept = rows.orderBy("telegram_id").collect()
        ids = []
        for r in kept:
            if self.dies_after is not None and len(self.posts) >= self.dies_after:
                raise ConnectionError("gone")
            self.posts.append((f"p{len(self.posts)}", r.message, r.delivery_key))
            ids.append((r.telegram_id, self.posts[-1][0]))
        found = self.spark.createDataFrame(ids, "telegram_id long, post_id string")
        return rows.join(found, "telegram_id").withColumn("media_mode", F.lit("text"))

    def listing(self):
        return self.spark.createDataFrame([(p, m, k) for k, (p, m, _) in enumerate(reversed(self.posts))], "post_id string, message string, rank long")


def batch(spark, *ids):
    return spark.createDataFrame([(k, f"Post  number {k}", "c", "https://s.example", f"f{k}", ("news",), []) for k in ids], ROW)


def test_batch_that_dies_is_sent_once(spark, tmp_path):
    book, sink = ledger.Ledger(spark, str(tmp_path / "ledger")), Sink(spark, dies_after=2)
    schema = "event string, telegram_id bigint"
    assert book.events(schema).count() == 0
    with pytest.raises(ConnectionError):
        ledger.deliver_once(batch(spark, 1, 2, 3), 7, book, sink.listing(), sink, now())
    assert len(sink.posts) == 2 and book.read("done", 7) is None and book.read("intents", 7).count() == 3
    sink.dies_after = None
    with pytest.raises(ledger.DeliveryDeferred):
        ledger.deliver_once(batch(spark, 1, 2, 3), 7, book, None, sink, now())
    # the second run gets other rows: the batch is still what it meant to send
    out = ledger.deliver_once(batch(spark, 1, 2, 3, 4), 7, book, sink.listing(), sink, now())
    assert {(r.telegram_id, r.facebook_post_id, r.media_mode) for r in out.collect()} == {(1, "p0", "recovered"), (2, "p1", "recovered"), (3, "p2", "text")}
    assert len(sink.posts) == 3 == len({key for *_, key in sink.posts})
    again = ledger.deliver_once(batch(spark, 1, 2, 3), 7, book, None, sink, now())
    assert again.count() == 3 and len(sink.posts) == 3
    assert again.first().delivery.content_type == "news" and again.first().media_errors == []
    ledger.deliver_once(batch(spark, 3, 5), 8, book, sink.listing(), sink, now())
    log = book.events(schema)
    assert {(r.telegram_id, r.batch) for r in log.collect()} == {(1, 7), (2, 7), (3, 7), (5, 8)} and len(sink.posts) == 4


def test_ledger_replaces_what_a_dead_writer_left(spark, tmp_path):
    left = tmp_path / "ledger" / "done" / "batch=1"
    left.mkdir(parents=True)
    (left / "part-0000.json").write_text(json.dumps({"half": 1}))
    book, sink = ledger.Ledger(spark, str(tmp_path / "ledger")), Sink(spark)
    assert book.read("done", 1) is None
    assert ledger.deliver_once(batch(spark, 1), 1, book, sink.listing(), sink, now()).count() == 1 and len(sink.posts) == 1
