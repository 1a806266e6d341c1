import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import gru, lmscore, neardup, pii, quality, queries

from .tables import clashing, documents, empty_documents, odd_documents

D = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


# --- quality ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    rng = random.Random(9)
    prose = lambda: " ".join(rng.choices("the of and a to in cat dog house tree runs sees big small old".split(), k=60))
    junk = lambda: " ".join(w.upper() + "!!" for w in prose().split())
    toxic = lambda: prose() + " you idiot " + prose() + " moron"
    rows, labels = [], []
    for k in range(600):
        make, q, t = ((prose, 1, 0), (prose, 1, 0), (prose, 1, 0), (junk, 0, 0), (toxic, 1, 1))[k % 5]
        rows.append((k, make()))
        if k % 2:
            labels.append((k, q, t))
    labels += [(None, 1, 0), (3, None, None), (99999, 1, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_resampling_separates(corpus):
    docs, labels = corpus
    kept = {r.doc_id for r in quality.resample(docs, labels).collect()}
    clean = {k for k in range(600) if k % 5 < 3}
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept - clean) <= 0.05 * len(clean)


def test_cut_is_the_kth_key(spark, monkeypatch):
    import random

    monkeypatch.setattr(quality, "MAX_KEYS", 20)
    rng = random.Random(10)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 200
    df = spark.createDataFrame([(v,) for v in values], "key double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 500, 1000, 1100, 2500, 3200):
        assert quality._kth(df, k) == order[k - 1]


def test_other_seeds_give_other_samples(spark):
    """With k below the number of target documents the noise decides among them: a brute-force top-k, and two seeds far apart."""
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    k = docs.count() // 4
    samples = []
    for seed in (1, 2):
        rows = {r.doc_id: r for r in quality.resample(docs, labels, seed=seed, k=k).collect()}
        samples.append(set(rows))
        models = quality.select(docs, labels, seed=seed, k=k).models
        noise = {r.doc_id: r.g for r in docs.select("doc_id", quality._gumbel(seed, "doc_id").alias("g")).collect()}
        ratio = {r.doc_id: float(models.log_ratio(models.log_likelihoods(r.text or "")[None])[0]) for r in docs.collect()}
        top = sorted(ratio, key=lambda i: -(ratio[i] + noise[i]))[:k]
        assert set(rows) == set(top)
        assert all(abs(rows[i].log_ratio - ratio[i]) < 1e-6 for i in rows)
    target = sum(r > -1 for r in ratio.values())
    assert len(samples[0]) == len(samples[1]) == k and abs(len(samples[0] & samples[1]) - k * k / target) < 0.5 * k


def test_gumbel_draws_in_proportion(spark):
    """Of three weights, which comes first over many seeds."""
    log_w = {1: 0.0, 2: math.log(2), 3: math.log(5)}
    noise = spark.createDataFrame([(i,) for i in log_w], "doc_id long")
    rows = noise.select("doc_id", *[quality._gumbel(s, "doc_id").alias(f"g{s}") for s in range(1500)]).collect()
    first = collections.Counter(max(rows, key=lambda r: r[f"g{s}"] + log_w[r.doc_id]).doc_id for s in range(1500))
    assert all(abs(first[i] / 1500 - math.exp(w) / 8) < 0.04 for i, w in log_w.items())


def test_quality_rows(spark, corpus):
    docs, labels = corpus
    rows = docs.unionByName(odd_documents(spark).withColumn("doc_id", F.col("doc_id") + 5000))
    kept = quality.keep_selected(clashing(rows), labels)
    assert kept.columns == clashing(rows).columns
    chosen = quality.resample(clashing(rows), labels)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in chosen.collect())
    assert quality.resample(empty_documents(spark), labels).count() == 0
    assert quality.keep_selected(empty_documents(spark), labels).count() == 0
    odd = odd_documents(spark)
    assert quality.resample(odd, labels.where("false")).count() == odd.count()


def test_quality_query(spark):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect()}
    share = lambda want: np.mean([k in kept for k, v in labels.items() if v == want])
    assert share((1, 0)) > 0.97 and share((0, 0)) < 0.1


# --- language model --------------------------------------------------------------------


def small_model():
    words = [(f"w{k}".encode(), 100 - k) for k in range(40)]
    v = gru.Vocabulary.build(words, np.arange(gru.BUCKETS) % 7, 30)
    m = gru.Model(v)
    rng = np.random.default_rng(11)
    for name in gru.NAMES:
        m.p[name] = m.p[name].astype(np.float64) + 0.3 * rng.standard_normal(m.p[name].shape)
    return m, rng


def test_probabilities_sum_to_one():
    m, rng = small_model()
    n = len(m.v.class_of)
    state = np.repeat(rng.standard_normal((1, gru.UNITS)), n, 0)
    assert abs(np.exp(m._log_p(state, np.arange(n))).sum() - 1) < 1e-6


def test_gradient():
    """Back-propagation through a window, against differences of the loss."""
    m, rng = small_model()
    n = len(m.v.class_of)
    x, y = rng.integers(0, n, (5, 3)), rng.integers(0, n, (5, 3))
    valid = np.ones((5, 3), bool)
    valid[4, 1] = False
    grads = {}
    m._move = lambda name, g, where: grads.__setitem__(name, (np.array(g), where))
    h = 0.1 * rng.standard_normal((3, gru.UNITS))
    m._window(x, y, valid, h)

    def loss():
        states = m._forward(x, h, [])
        rows = np.nonzero(valid)
        return -m._log_p(np.asarray(states, np.float64)[rows], y[rows]).mean()

    for name, (g, where) in grads.items():
        full = np.zeros(m.p[name].shape)
        full[where] = g
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in full.shape) if name not in ("inp",) else (int(x[rng.integers(0, 5), 0]), int(rng.integers(0, 3 * gru.UNITS)))
            old, step = m.p[name][at], 1e-2
            m.p[name][at] = old + step
            up = loss()
            m.p[name][at] = old - step
            down = loss()
            m.p[name][at] = old
            assert abs((up - down) / (2 * step) - full[at]) < 2e-3 + 0.03 * abs(full[at]), (name, at)


def test_score_carries_the_state():
    """Scored together in windows, or a symbol at a time: the same."""
    m, rng = small_model()
    n = len(m.v.class_of)
    texts = [np.append(rng.integers(1, n, k), 0) for k in (0, 1, 15, 16, 17, 50)]
    got = m.score(texts)
    for t, s in zip(texts, got):
        h, total = np.zeros((1, gru.UNITS), np.float32), 0.0
        for before, now in zip([0, *t[:-1]], t):
            h = m._forward(np.array([[before]]), h)[0]
            total += m._log_p(h, np.array([now]))[0]
        assert abs(total / math.log(10) - s) < 1e-3


def plain_base(rows):
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    cut = lambda t: (t or "").encode().lower().split()
    counts, ends = collections.Counter(), 0
    for k, t in rows:
        if not held(k):
            counts.update(cut(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for k, t in rows:
        w = cut(t)
        score = sum(math.log10(counts.get(x, 0) + 1) for x in w) + math.log10(ends + 1) - (len(w) + 1) * math.log10(total + distinct + 1)
        out.append((str(k), held(k), len(w) + 1, sum(x in counts for x in w) + (ends > 0), total, round(score, 5)))
    return sorted(out)


@pytest.mark.parametrize("common", [40, 1 << 17])
def test_baseline(spark, monkeypatch, common):
    """Against plain counting, also where most words aren't common."""
    monkeypatch.setattr(lmscore, "MAX_COMMON", common)
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{D}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100))
    rows = lmscore.score(clashing(docs)).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    want = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-4 * max(1, abs(w[5])) for g, w in zip(got, want))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_scores_beat_the_baseline(spark):
    rows = [r for r in queries.op10_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_no_documents(spark):
    assert lmscore.score(empty_documents(spark)).count() == 0
    only_held = documents(spark, [(k, "a b") for k in range(40) if lmscore.held_out(k)])
    assert all(r.held_out and r.base_score == 0 for r in lmscore.score(only_held).collect())


# --- pipeline --------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage's rows against its operator's own account of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(spark, stage(spark, docs, "/root/testdata/sf0.01"))
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) == out.count()
        if number < 4:
            assert out.columns == columns
        if name == "near_duplicates":
            found = neardup.near_duplicates(docs).collect()
            assert after == {r.component_id for r in found}
        if name == "personal_data":
            assert after == before
            assert all(not r.n_email for r in pii.digests(pii.find_personal(out)).collect())
        seen.append(len(after))
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[0] < 1000
    assert docs.columns[:3] == ["doc_id", "ids", "n_tokens"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.01").count() == seen[-1]


def test_pipeline_odd_rows(spark, tmp_path):
    docs = clashing(odd_documents(spark))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(spark, stage(spark, docs, D))
    assert docs.count() >= 5
    empty = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(spark, stage(spark, empty, D))
    assert empty.count() == 0
