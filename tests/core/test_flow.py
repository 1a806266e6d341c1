"""The flow's rules on small tables, with results that are known."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions import media as M
from quillstream.functions import text as X
from quillstream.functions import tokens as K
from quillstream.functions import urls as U
from quillstream.functions.times import retry_at, timestamp
from quillstream.operators import dedupe, events, gates, merge, prepare, queue, rights, threads
from quillstream.sources import html, jsonl, sinks

NOW = datetime(2026, 10, 2, 12, tzinfo=timezone.utc)
AT = "2026-10-02T12:00:00+00:00"


def now():
    return F.lit(AT).cast("timestamp")


def one(spark, *columns, **values):
    """The columns' values over one row of text columns."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return row.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def ago(**x):
    return (NOW - timedelta(**x)).isoformat()


def log(spark, rows):
    fields = ["event", "telegram_id", "facebook_post_id", "published_at", "first_comment", "retry_at"]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) + (k,) for k, r in enumerate(rows)], "event string, telegram_id long, facebook_post_id string, published_at string, first_comment string, retry_at string, ingest_seq long")


def item(spark, **over):
    base = {"language": "en", "source_published_at": ago(hours=1), "facebook_post": "A plain post.", "card_title": "A title", "source_url": "", "telegram_id": 7, "editorial": ("none", "general"), "primary_evidence": []}
    base |= over
    schema = "language string, source_published_at string, facebook_post string, card_title string, source_url string, telegram_id long, editorial struct<attention_label:string,content_type:string>, primary_evidence array<struct<url:string>>"
    return spark.createDataFrame([tuple(base.values())], schema)


def reason(spark, published=(), **over):
    rows = [{"event": "published", "facebook_post_id": p, "telegram_id": 1, "published_at": ago(minutes=30)} for p in published]
    return queue.with_reasons(item(spark, **over), log(spark, rows), now()).first().reason


def test_eligibility_ladder(spark):
    assert reason(spark) == ""
    assert reason(spark, language="ar") == "pending_english_rewrite"
    assert reason(spark, source_published_at=ago(hours=25)) == "stale_source"
    assert reason(spark, source_published_at="None") == reason(spark, source_published_at=ago(minutes=-6)) == "unverified_source_date"
    assert reason(spark, published=["a", "b"]) == "rolling_hourly_cap"
    assert reason(spark, published=["a", "a", "a"]) == ""
    assert reason(spark, facebook_post=" \n", language="ar") == "missing_editorial_text"


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("The court charged a man.", "sensitive_claim_without_source"),
        ("Pwn2Own results are out.", "competition_result_without_source"),
        ("A breach was disputed.", "disputed_intrusion_without_source"),
        ("It gave no supporting evidence.", "unsupported_low_information_claim"),
    ],
)
def test_evidence_gates(spark, text, why):
    assert reason(spark, facebook_post=text) == why
    assert reason(spark, facebook_post=text, source_url="https://a.example/x") == ""
    assert reason(spark, facebook_post=text, primary_evidence=[("https://a.example/x",)]) == ""


def test_merge_keeps_better_and_first(spark):
    schema = "telegram_id long, status string, title string, editorial_version long, ingest_seq long"
    remote = spark.createDataFrame([(10, "ready", None, None, 1), (11, "ready", "x", None, 2)], schema)
    local = spark.createDataFrame([(10, "ready", None, 2, 1), (12, "ready", None, None, 2), (11, "ready", "y", None, 3)], schema)
    rows = merge.merge_logs(remote, local, merge.id_key).orderBy("position").collect()
    assert [(r.telegram_id, r.title, r.editorial_version) for r in rows] == [(10, None, 2), (11, "x", None), (12, None, None)]
    back = merge.merge_logs(local, remote, merge.id_key).where("telegram_id = 10").first()
    assert back.editorial_version == 2
    raw = merge.merge_logs(remote.withColumn("telegram_id", F.lit(0).cast("long")), remote.withColumn("telegram_id", F.lit(0).cast("long")), merge.id_key)
    assert raw.count() == 2


def test_latest_version_prefers_later_line(spark):
    rows = spark.createDataFrame([(1, 2, "a", 1), (1, 2, "b", 2), (1, 1, "c", 3)], "telegram_id long, editorial_version long, t string, ingest_seq long")
    assert merge.latest_version(rows).first().t == "b"


def test_states(spark):
    s = "last_seen_id long, updated_at string"
    side = lambda *r: spark.createDataFrame([r], s)
    assert merge.merge_collector_state(side(20, "b"), side(21, "a")).first().last_seen_id == 21
    assert merge.merge_collector_state(side(20, "b"), side(20, "b").withColumn("updated_at", F.lit("b"))).count() == 1
    p = "last_processed_id long, processed_count long, updated_at string"
    out = merge.merge_prepare_state(spark.createDataFrame([(20, 51, "a")], p), spark.createDataFrame([(21, 50, "b")], p)).first()
    assert tuple(out) == (21, 51, "b")
    done = spark.createDataFrame([(30,), (25,)], "telegram_id long")
    assert tuple(merge.advance_state(spark.createDataFrame([(21, 50, "b")], p), done, F.lit("c")).first()) == (30, 52, "c")


def test_comment_flag_depends_on_order(spark):
    e = lambda kind, tid: {"event": kind, "telegram_id": tid, "first_comment": "hi", "facebook_post_id": f"p{tid}"}
    rows = [e("comment_posted", 1), e("published", 1), e("published", 2), e("comment_posted", 2), e("published", 3), e("comment_posted", 3), e("published", 3)]
    out = {r.telegram_id: r.comment_posted for r in events.delivery_state(log(spark, rows)).collect()}
    assert out == {1: False, 2: True, 3: False}
    assert [r.telegram_id for r in events.comments_to_retry(log(spark, rows)).collect()] == [1, 3]


def test_cooldown(spark):
    rows = [{"event": "meta_cooldown", "retry_at": ago(minutes=-10)}, {"event": "meta_cooldown", "retry_at": ago(minutes=1)}]
    assert events.cooling_until(log(spark, rows), now()).first().cooling_until is not None
    assert events.cooling_until(log(spark, rows[1:]), now()).first().cooling_until is None
    r = one(spark, retry_at(now(), F.lit("5")), retry_at(now(), F.lit("x")), retry_at(now(), F.lit("300")))
    assert [(x.replace(tzinfo=timezone.utc) - NOW).seconds for x in r] == [60, 900, 300]


def test_probe(spark):
    inbox = spark.createDataFrame([(1748, )], "telegram_id long")
    ready = spark.createDataFrame([(1748, "ready")], "telegram_id long, status string")
    empty = log(spark, [])
    ask = lambda i, r, e, **x: tuple(queue.probe(i, r, e, 10, 12, **x).first())[:3]
    assert ask(inbox, ready.where("false"), empty) == (True, "pending_ai_retry", [1748])
    assert ask(inbox, ready, empty) == (True, "pending_facebook_queue", [1748])
    out = log(spark, [{"event": "published", "telegram_id": 1748, "first_comment": "see"}])
    assert ask(inbox, ready, out) == (True, "pending_first_comment_retry", [1748])
    both = log(spark, [{"event": "published", "telegram_id": 1748, "first_comment": "see"}, {"event": "comment_posted", "telegram_id": 1748}])
    assert ask(inbox, ready, both) == (True, "new_telegram_content", [])
    assert ask(inbox, ready, both, scheduled=True)[1] == "scheduled_full_poll"
    assert tuple(queue.probe(inbox, ready, both, 12, 12).first())[:2] == (False, "idle_up_to_date")


def test_preparation_queue(spark):
    inbox = spark.createDataFrame([(k,) for k in (5, 1, 2, 3, 4, 0)], "telegram_id long")
    ready = spark.createDataFrame([(1, "ready", "en", [3]), (2, "ready", "ar", None)], "telegram_id long, status string, language string, telegram_ids array<long>")
    done = log(spark, [{"event": "expired", "telegram_id": 4}, {"event": "editorial_hold", "telegram_id": 5}])
    assert [r.telegram_id for r in queue.to_prepare(inbox, ready, done).collect()] == [2, 5]


def test_priority(spark):
    rows = [(1, "none", "general", ago(hours=1)), (2, "breaking", "general", ago(hours=2)), (3, "none", "vulnerability", ago(hours=7)), (4, "important", "tool", ago(hours=1))]
    df = spark.createDataFrame(rows, "telegram_id long, a string, t string, at string")
    order = df.orderBy(queue.priority(F.col("a"), F.col("t"), timestamp(F.col("at")), F.col("telegram_id"), now())).collect()
    assert [r.telegram_id for r in order] == [2, 3, 4, 1]


def test_reply_context(spark):
    rows = spark.createDataFrame([(1, 2, "a", 1), (2, 1, "b", 2), (3, 2, "c", 3), (9, 8, "z", 4), (3, 2, "c", 5)], "telegram_id long, reply_to_id long, text string, ingest_seq long")
    out = {r.telegram_id: [c.telegram_id for c in r.reply_context] for r in threads.reply_context(rows, rows).collect()}
    assert out == {1: [1, 2], 2: [2, 1], 3: [1, 2], 9: []}


def test_rights(spark):
    rule = "status string, reupload_allowed boolean, basis string, license_note string, clip_start_seconds string, max_clip_seconds string"
    items = spark.createDataFrame([(1, ("https://t.me/chan/1", None)), (2, ("https://t.me/CHAN/2", None)), (3, ("https://t.me/other/3", None)), (4, ("https://t.me/chan/4", ("owned", None, None, None, "x", "0")))], f"telegram_id long, media struct<telegram_post_url:string,video_rights:struct<{rule.replace(' ', ':').replace(',:', ',')}>>")
    over = spark.createDataFrame([("1", "licenced", True, None, None, "-1", "5")], "item string, " + rule)
    chan = spark.createDataFrame([("@Chan", "owned", True, None, None, None, None)], "channel string, " + rule)
    out = {r.telegram_id: r.rights for r in rights.video_rights(items, over, chan).collect()}
    assert (out[1].status, out[1].reupload_allowed, out[1].clip_start_seconds, out[1].max_clip_seconds) == ("unknown", False, 0.0, 5.0)
    assert (out[2].status, out[2].reupload_allowed, out[2].basis) == ("owned", True, "explicit_channel_policy")
    assert (out[3].status, out[3].reupload_allowed, out[3].scope) == ("unknown", False, "telegram_channel:@other")
    assert (out[4].status, out[4].reupload_allowed, out[4].max_clip_seconds) == ("owned", False, None)


STORY = "telegram_id long, source_published_at string, status string, card_title string, source_url string, editorial struct<main_fact:string,supporting_facts:array<string>,protected_entities:array<string>,protected_numbers:array<string>>, ingest_seq long"


def story(tid, main, when=1, entities=(), numbers=(), url="", status="ready"):
    return (tid, ago(hours=when), status, "", url, (main, [], list(entities), list(numbers)), tid)


def test_stories(spark):
    a = story(1680, "Vendor patches a critical flaw in routers sold worldwide", 5, ["Vendor", "RouterOS"], ["9.8"])
    b = story(1682, "Vendor patches critical flaw in routers sold worldwide today", 1, ["Vendor", "RouterOS"], ["9.8"])
    c = story(1683, "Another company reports a phishing wave against banks", 1, ["Bank"], ["12"])
    d = story(1684, "Vendor patches critical flaw in routers sold worldwide today", 1, ["Vendor"], ["7.0"])
    rows = spark.createDataFrame([a, b, c, d], STORY)
    found = dedupe.best_match(rows.where("telegram_id > 1680"), rows.where("telegram_id = 1680")).collect()
    assert [(r.telegram_id, r.duplicate_of) for r in found] == [(1682, 1680)]
    far = dedupe.best_match(spark.createDataFrame([b], STORY), spark.createDataFrame([story(1, "Vendor patches critical flaw in routers sold worldwide today", 120, ["Vendor"], ["9.8"])], STORY))
    assert far.count() == 0
    url = dedupe.best_match(spark.createDataFrame([story(5, "x y z", url="https://A.example/p/?id=1")], STORY), spark.createDataFrame([story(4, "q", 400, url="https://a.example/p?id=2"), story(3, "q", 400, url="https://a.example/p")], STORY))
    assert [(r.duplicate_of, r.reason) for r in url.collect()] == [(3, "same_source_url")]
    aside = dedupe.best_match(spark.createDataFrame([b], STORY), spark.createDataFrame([story(1, "Vendor patches critical flaw in routers sold worldwide today", 1, ["Vendor"], ["9.8"], status="duplicate")], STORY))
    assert aside.count() == 0


def test_greedy_walk(spark):
    import random

    rng = random.Random(3)
    words = [f"word{k}" for k in range(12)]
    rows = [story(k, " ".join(rng.sample(words, 6))) for k in range(1, 60)]
    df = dedupe.with_story(spark.createDataFrame(rows, STORY))
    pairs = {(r.later, r.earlier) for r in dedupe.duplicate_pairs(df).collect()}
    sets = {r.telegram_id: set(r.story.main) for r in df.collect()}
    plain = {(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert pairs == plain
    kept: list[int] = []
    for k in sorted(sets):
        if not any((k, j) in plain for j in kept):
            kept.append(k)
    out = {r.telegram_id: r.duplicate_of for r in dedupe.greedy_duplicates(df).collect()}
    assert sorted(k for k, v in out.items() if v is None) == kept and len(out) == len(sets)


def test_fingerprint_equals_sorted_json(spark):
    import hashlib

    rows = spark.createDataFrame([story(1, 'He said "go"\t\\ ok', entities=["Zed", "alpha"], numbers=["7"], url="https://X.example/a/")], STORY)
    want = json.dumps({"entities": ["alpha", "zed"], "main": 'he said "go" \\ ok', "numbers": ["7"], "url": "https://x.example/a"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert dedupe.annotate(rows).first().story_fingerprint == hashlib.sha256(want.encode()).hexdigest()


def test_primary_links(spark):
    good = ["https://www.cisa.gov/x", "https://nvd.nist.gov:443/v", "https://WWW.CVE.org/a"]
    bad = ["https://www.cisa.gov.evil.com/", "http://www.cisa.gov/", "https://u@www.cisa.gov/", "https://1.2.3.4/", "https://www.cisa.gov:8443/"]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert {r.u for r in df.where(U.is_primary(F.col("u"))).collect()} == set(good)


def test_texts(spark):
    t = F.lit
    r = one(
        spark,
        X.clean_post(t("Hi @Own there\n\n\nFollow us on Twitter\n\n read more \nhttps://own.example/a https://x.example/b\nend "), lambda u: U.is_own(u, ["own.example"]), [r"@Own\b"]),
        X.unique(F.array(t(" a"), t("b"), t(""), t("a "))),
        X.normal_form(t("‎Ünï  أحمد https://a.b/c X")),
        X.strip_attention_prefix(t("BREAKING: ALERT - Big")),
        X.clean_owned_tokens(t("🚨 News #tag\r\nWARNING: x https://a.b y")),
        X.unwrap_latin_parentheses(t("a (b (c d)) e")),
        X.remove_title_repeat(t("Same title!"), t("same Title\n\nBody")),
        X.repeats_opening(t("New tool out"), t("New tool arrives\n\nx")),
        X.delivery_rejects(t("see http://a #a #b #c")),
        K.numbers(t("1,000 and 50% at 3.5. v2 https://a/9")),
        K.identifier_numbers(t("TA419 and GPT-4o 110TB plain")),
        K.strict_tokens(t("OpenAI and FBI with GPT-4o")),
        K.missing_entities(F.array(t("OneDrive app"), t("Dutch police")), t("onedrive is back")),
        X.rtl_lead(t("!"), t("⁧abc⁩")),
    )
    assert r.c0 == "Hi  there\n\nhttps://x.example/b\nend"
    assert r.c1 == ["a", "b"]
    assert r.c2 == "ünï احمد x"
    assert r.c3 == "Big"
    assert r.c4 == "News\nx y"
    assert r.c5 == "a b c d e"
    assert r.c6 == "Body"
    assert r.c7 is True
    assert r.c8 == ["link_in_body", "too_many_hashtags"]
    assert sorted(r.c9) == ["1000", "3.5", "50%"]
    assert sorted(r.c10) == ["110", "4", "419"]
    assert r.c11 == ["OpenAI", "GPT-4o"]
    assert r.c12 == []
    assert r.c13 == "⁧! abc⁩"


def test_layouts(spark):
    long = "One sentence here. " * 20
    df = spark.createDataFrame([("a\nb\n- item\nc", long, "Use OpenAI API على https://x.example/a")], "a string, b string, c string")
    r = df.select(X.reading_layout(F.col("a")).alias("a"), X.split_paragraph(F.col("b")).alias("b"), X.force_rtl(F.col("c")).alias("c")).first()
    assert r.a == "a b\n- item\n\nc"
    assert all(len(p) <= 240 for p in r.b) and " ".join(r.b) == long.strip()
    assert r.c == "⁧⁨Use OpenAI API⁩ على https://x.example/a⁩"


def test_paragraphs_are_split_between_sentences_or_words(spark):
    sentences = ["S" * 100 + ".", "T" * 150 + "?", "U" * 90 + "!", "V" * 300 + ".", "W."]
    words = " ".join(["ab" * 20] * 14)
    rows = [(0, " ".join(sentences)), (1, words), (2, "x" * 500 + " " + "y" * 300), (3, None), (4, " \t "), (5, "short  one"), (6, "z" * 100 + " " + "w" * 400)]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, a string").select("k", X.split_paragraph(F.col("a")).alias("p")).collect()}
    assert got[0] == [sentences[0], f"{sentences[1]}", sentences[2], sentences[3], sentences[4]] or got[0] == [sentences[0], " ".join(sentences[1:3]), *sentences[3:]]
    assert " ".join(got[1]) == words and [len(p) for p in got[1]] == [204, 204, 163]
    assert got[2] == ["x" * 500, "y" * 300] and got[3] == got[4] == [] and got[5] == ["short one"] and got[6] == [f"{'z' * 100} {'w' * 400}"]


def test_layout_of_lines(spark):
    rows = {
        0: ("a\r\nb\n\n\n\nc\n- one\n2) two\nd", "a b\n\nc\n- one\n2) two\n\nd"), 1: (None, ""), 2: ("\n\n x \n", "x"), 3: ("• a\n\n• b\ntail", "• a\n\n• b\n\ntail"),
        4: ("Word. " * 50 + "\n- item", " ".join(["Word."] * 40) + "\n\n" + " ".join(["Word."] * 10) + "\n- item"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "k int, a string")
    assert {r.k: r.t for r in df.select("k", X.reading_layout(F.col("a")).alias("t")).collect()} == {k: v[1] for k, v in rows.items()}
    assert not any(x in df.select(X.reading_layout(F.col("a")))._jdf.queryExecution().toString() for x in ("Python", "Arrow"))


def test_parentheses_of_any_depth(spark):
    deep = "a " + "(b " * 9 + "c" + ")" * 9 + " d (دبي) e"
    assert one(spark, X.unwrap_latin_parentheses(F.lit(deep))).c0 == "a " + "b " * 9 + "c d (دبي) e"


def test_signals_and_rejects(spark):
    t = F.lit
    r = one(
        spark, X.attention(t("BREAKING: x"), t("none"), t("")), X.attention(t("calm"), t("breaking"), t("e")), X.certainty(t("allegedly so"), t("confirmed")),
        gates.fidelity_rejects(t("About 2 flaws CVE-2024-1234"), t("About 3 flaws")), gates.evidence_rejects(t("2 flaws"), t("99 hosts"), t("2 flaws, 99 hosts")),
        gates.reader_rejects(t("kernel firmware"), t("x")), gates.english_reason(t("مرحبا")), M.processing_seconds(t(1200.0)), M.image_score(t(1600), t(900), t(130000), t(True)),
        U.srcset(t("a.jpg 100w, b.jpg 900w, c.jpg")), U.file_name(t("https://a/b/pic.png?x=1"), t("")), U.channel(t("https://t.me/@chan/5")), U.background_image(t("x:y; background-image: url('https://a/b.jpg')")),
    )
    assert r.c0 == ("breaking", "source_explicit_breaking") and r.c1 == ("none", "") and r.c2 == "attributed"
    assert r.c3 == ["numbers_invented", "numbers_omitted", "cves_omitted"] and r.c4 == [] and r.c5 == ["title_jargon"] and r.c6 == "not_english"
    assert r.c7 == 2340 and abs(r.c8 - 1600 * 900 * 1.35 * 1.15 * 1.18 * 1.08 * 1.25) < 1e-3
    assert r.c9 == ["b.jpg", "a.jpg", "c.jpg"] and r.c10 == "pic.png" and r.c11 == "chan" and r.c12 == "https://a/b.jpg"


PAGE = """<div class="m" data-post="chan/7"><div class="m_text">Hello <b>all</b><br>https://src.example/a.</div><time></time>
<a class="m_reply" href="https://t.me/chan/5?x">r</a><a href="https://t.me/chan">c</a><div class="m_photo_wrap" style="background-image:url('https://cdn/p.jpg')"></div></div>
<div class="m" data-post="chan/x"></div><div class="m" data-post="chan/8"><div class="m_video_player"><video src="https://cdn/v.mp4"></video></div><time datetime=" 2026-10-02T11:00:00+00:00 "></time></div>"""


def test_messages(spark):
    pages = spark.createDataFrame([(PAGE,)], "html string")
    rows = {r.telegram_id: r for r in html.read_messages(pages, css="m", post_base="https://t.me/chan/").collect()}
    assert set(rows) == {7, 8}
    a, b = rows[7], rows[8]
    assert (a.published_at, a.reply_to_id, a.raw_text, a.media_type, a.image_url) == (None, 5, "Hello\nall\nhttps://src.example/a.", "image", "https://cdn/p.jpg")
    assert a.source_links == ["https://src.example/a"] and a.telegram_post_url == "https://t.me/chan/7"
    assert (b.media_type, b.video_url, b.published_at) == ("video", "https://cdn/v.mp4", "2026-10-02T11:00:00+00:00")
    assert set(rows[7].asDict()) == set(schemas.INBOX.fieldNames())
    assert html.latest_id(pages).first().latest == 8


def test_enrich(spark):
    body = "<title>T</title><nav><p>security update menu that is long enough to count as sixty characters</p></nav><article><p>The security update fixes two flaws in the router firmware sold worldwide.</p><p>short</p></article>"
    items = spark.createDataFrame([(1, "A security update fixes router flaws", ["https://x.example/", "https://www.cisa.gov/a"])], "telegram_id long, text string, source_links array<string>")
    pages = spark.createDataFrame([("https://www.cisa.gov/a", body)], "url string, html string")
    got = html.enrich(items, pages, now()).first().primary_evidence
    assert len(got) == 1 and got[0].title == "T" and got[0].text.startswith("The security update") and "menu" not in got[0].text


def test_answers(spark):
    good = {n: "x" for n in schemas.ANSWER_TEXTS} | {"language": "en", "facebook_post": "Vendor reportedly fixed 2 flaws.", "supporting_facts": "one", "protected_entities": [" A ", ""], "protected_numbers": []}
    rows = [("Sure: " + json.dumps(good) + " done",), ("[1]",), ("no",), ('{"title": "x"}',)]
    df = spark.createDataFrame(rows, "t string").select(prepare.parse_answer(F.col("t")).alias("answer"))
    a, b, c, e = [r.answer for r in df.collect()]
    assert a.problem is None and a.data.supporting_facts == ["one"] and a.data.protected_entities == ["A"]
    assert b.problem == "not_an_object" and c.problem == "not_json" and e.problem.startswith("missing: ")
    checked = df.where("answer.data is not null").select(F.col("answer.data").alias("data"), F.array(F.lit("https://s.example/a")).alias("source_links"), F.lit("Vendor fixed 2 flaws").alias("text"), F.array().cast(schemas.EVIDENCE).alias("primary_evidence"))
    r = prepare.enforce_policy(checked).first()
    assert r.reject_reasons == [] and r.certainty == "reported" and r.first_comment == "Source: https://s.example/a"


def test_logs_and_sinks(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"telegram_id": 2, "status": "a"}\n\n{"telegram_id": 1}\n[3]\n')
    rows = jsonl.read_log(spark, str(p), schemas.INBOX, objects_only=True).orderBy("ingest_seq").collect()
    assert [(r.telegram_id, r.status) for r in rows] == [(2, "a"), (1, None)]
    assert jsonl.newest_line(jsonl.read_log(spark, str(p), schemas.INBOX, objects_only=True)).first().telegram_id == 1
    assert jsonl.read_log(spark, str(tmp_path / "none"), schemas.INBOX).count() == 0
    p.write_text('{"telegram_id": 2}\n{bad\n')
    with pytest.raises(Exception, match="malformed line"):
        jsonl.read_log(spark, str(p), schemas.INBOX).collect()
    state = jsonl.read_state(spark, str(tmp_path / "s.json"), schemas.COLLECTOR_STATE, {"last_seen_id": 0})
    assert state.first().last_seen_id == 0
    items = spark.createDataFrame([(1, "Hello  World", "c", "u", "f"), (2, "New", "c", "u", "f")], "telegram_id long, message string, first_comment string, source_url string, story_fingerprint string")
    remote = spark.createDataFrame([("r9", "hello world", 1)], "post_id string, message string, rank long")
    out = {r.telegram_id: (r.facebook_post_id, r.media_mode) for r in sinks.deliver(items, remote, sinks.Recorder(), now()).collect()}
    assert out == {1: ("r9", "recovered"), 2: ("recorded-2", "text")}
    assert sinks.comment_events(items, sinks.Recorder(), now()).count() == 2
