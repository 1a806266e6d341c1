"""Policies from files, rows chosen by rules, and small expressions beside them."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.functions import urls as U
from quillstream.operators import rights, targets
from quillstream.sources import policy


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_timing(spark, tmp_path):
    full = {"language": {"primary": "en"}, "publishing_policy": {"minimum_gap_minutes": 45, "max_posts_rolling_hour": 3, "max_posts_rolling_24h": 20, "max_source_age_hours": 12}}
    assert policy.read_timing(spark, write(tmp_path / "a.json", full)) == policy.Timing(True, 45.0, 3, 20, 12.0)
    part = {"language": {"primary": "ar"}, "publishing_policy": {"minimum_gap_minutes": "soon", "max_posts_rolling_hour": -1}}
    assert policy.read_timing(spark, write(tmp_path / "b.json", part)) == policy.Timing()
    assert policy.read_timing(spark, str(tmp_path / "none.json")) == policy.Timing()
    broken = write(tmp_path / "c.json", "{no")
    assert policy.read_timing(spark, broken) == policy.Timing()
    with pytest.raises(policy.PolicyError):
        policy.read_timing(spark, broken, strict=True)


def test_rights_file(spark, tmp_path):
    rules = {"version": 1, "default_status": "denied", "post_overrides": {"7": {"status": "licensed", "reupload_allowed": True, "max_clip_seconds": 9}}, "channel_policies": {"Chan": {"status": "owned", "reupload_allowed": True}}}
    overrides, channels, default = policy.read_rights(spark, write(tmp_path / "r.json", rules))
    row = "struct<status:string,reupload_allowed:boolean,basis:string,license_note:string,clip_start_seconds:string,max_clip_seconds:string>"
    items = spark.createDataFrame([(7, "https://t.me/x/1"), (8, "https://t.me/chan/2"), (9, "https://t.me/y/3")], "telegram_id long, u string")
    items = items.select("telegram_id", F.struct(F.col("u").alias("telegram_post_url"), F.lit(None).cast(row).alias("video_rights")).alias("media"))
    got = {r.telegram_id: (r.rights.status, r.rights.reupload_allowed) for r in rights.video_rights(items, overrides, channels, default).collect()}
    assert got[7] == ("licensed", True) and got[9] == ("denied", False)
    empty = policy.read_rights(spark, str(tmp_path / "none.json"))
    assert empty[0].count() == empty[1].count() == 0 and empty[2] == "unknown"
    with pytest.raises(policy.PolicyError):
        policy.read_rights(spark, write(tmp_path / "list.json", [1]))


def test_names():
    assert policy.distinct_names(" a, b,,a", "c", ["b", "d"]) == ["a", "b", "c", "d"]
    assert policy.distinct_names(None, None, ["x"]) == ["x"]


def test_exactly_one(spark):
    rows = spark.createDataFrame([(1, "Maps of the Strip", ["https://a.example/X"]), (2, "Agents by OPEN", None), (3, None, [])], "telegram_id long, text string, links array<string>")
    h = targets.haystack(F.col("text"), F.col("links"))
    rules = {"maps": F.contains(h["text"], F.lit("maps")) & F.contains(h["links"], F.lit("a.example/x")), "open": F.contains(h["text"], F.lit("open"))}
    assert {r.telegram_id: r.rule for r in targets.exactly_one(rows, rules).collect()} == {1: "maps", 2: "open"}
    with pytest.raises(ValueError, match="none"):
        targets.exactly_one(rows, {**rules, "none": F.lit(False)})
    with pytest.raises(ValueError, match="exactly one row"):
        targets.exactly_one(rows.union(rows), rules)
    with pytest.raises(ValueError, match="same row"):
        targets.exactly_one(rows, {**rules, "again": rules["open"]})


def test_small_expressions(spark):
    urls = {"https://t.me/x": False, "http://telegram.org/": False, "https://news.example/a": True, "ftp://x.example": False, "": False, None: False}
    got = spark.createDataFrame(list(urls.items()), "u string, want boolean").select("u", U.leaves_messenger(F.col("u")).alias("got"))
    assert {r.u: bool(r.got) for r in got.collect()} == urls
    words = F.array(*[F.lit(w) for w in "one two three four".split()])
    r = spark.range(1).select(X.lines_at(words, F.array(F.lit(1), F.lit(3))).alias("a"), X.lines_at(words, F.array().cast("array<int>")).alias("b")).first()
    assert r.a == ["one", "two three", "four"] and r.b == ["one two three four"]
