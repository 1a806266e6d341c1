"""Answers of a site, counters of a run, even lines."""

from datetime import datetime, timedelta, timezone
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quillstream.functions import lines as L
from quillstream.operators import counters, events, responses


def test_answers_of_all_shapes(spark):
    rows = [
        (1, 200, None, '{"id": "5"}'), (2, 200, None, ""), (3, 200, None, None), (4, None, None, "{}"), (5, 200, None, "[1]"), (6, 404, None, "[1]"), (7, 403, None, '{"error": {"message": "", "code": 4}}'),
        (8, 429, "soon", "x"), (9, 429, "7", None), (10, 429, None, "{}"), (11, 200, None, '{"error": "text"}'), (12, 399, None, '{"data": {"error": 1}}'),
    ]
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame(rows, "k int, status int, retry_after string, body string")
    judged = responses.judged(df, F.lit(now))
    got = {r.k: (r.outcome, r.error, r.us) for r in judged.withColumn("us", F.unix_seconds("retry_at")).collect()}
    at = lambda s: int((now + timedelta(seconds=s)).timestamp())
    none = "(code=None, subcode=None)"
    assert got == {
        1: ("sent", None, None), 2: ("failed", "no JSON in answer 200", None), 3: ("failed", "no JSON in answer 200", None), 4: ("failed", f"None {none}", None), 5: ("sent", None, None),
        6: ("failed", f"404 {none}", None), 7: ("failed", "403 (code=4, subcode=None)", None), 8: ("cooldown", "rate limited", at(900)), 9: ("cooldown", "rate limited", at(60)),
        10: ("cooldown", "rate limited", at(900)), 11: ("failed", f"200 {none}", None), 12: ("sent", None, None),
    }
    until = events.cooling_until(responses.cooldown_events(judged, F.lit(now)), F.lit(now)).select(F.unix_seconds("cooling_until")).first()[0]
    assert until == at(900)


def test_counters_come_with_the_write(spark, tmp_path):
    df = spark.range(10).select((F.col("id") + 1).alias("telegram_id"), "id")
    tables, seen = counters.observed_run({"ready": df, "none": df.where("id < 0"), "plain": df.select("id")})
    for name, t in tables.items():
        t.write.parquet(str(tmp_path / name))
    assert seen["ready"].get == {"rows": 10, "last_id": 10}
    assert seen["none"].get == {"rows": 0, "last_id": None}
    assert seen["plain"].get == {"rows": 10}


def _best(widths, lines, most):
    found = None
    for cuts in combinations(range(1, len(widths)), lines - 1):
        bounds = [0, *cuts, len(widths)]
        w = [sum(widths[a:b]) + b - a - 1 for a, b in zip(bounds, bounds[1:])]
        mean = sum(w) / lines
        score = round(sum(abs(x - mean) for x in w) + max(0.0, mean * 0.58 - w[-1]) * 1.7, 6)
        if max(w) <= most and (found is None or score < found[0]):
            found = (score, cuts, w)
    return found


def test_even_lines_against_all_cuts(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(1, 12, rng.integers(0, 11)).tolist()) for k in range(60)] + [(60, None), (61, [9]), (62, [40, 1, 1])]
    df = spark.createDataFrame(rows, "k int, w array<int>")
    for lines in (1, 2, 3, 4):
        got = {r.k: r.c for r in df.select("k", L.balanced_cuts(F.col("w"), lines, 30.0).alias("c")).collect()}
        for k, w in rows:
            want = _best(w, lines, 30) if w and len(w) >= lines else None
            assert (got[k] is None) == (want is None), (k, lines)
            if want:
                bounds = [0, *got[k], len(w)]
                made = [sum(w[a:b]) + b - a - 1 for a, b in zip(bounds, bounds[1:])]
                mean = sum(made) / lines
                assert abs(sum(abs(x - mean) for x in made) + max(0.0, mean * 0.58 - made[-1]) * 1.7 - want[0]) < 1e-5
