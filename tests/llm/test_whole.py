"""Corpus operators over all that narrower versions of them left out."""

import random
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import bpe, gru, lmscore, neardup, quality, queries, simhash

from .tables import documents
from .test_dedup import groups


def statistics(texts):
    words = Counter(w for t in texts for w in lmscore.split_words(t))
    tokens, distinct = np.zeros(gru.BUCKETS), np.zeros(gru.BUCKETS)
    for w, n in words.items():
        tokens[gru.bucket_of(w)] += n
        distinct[gru.bucket_of(w)] += 1
    return lmscore.Statistics(list(words.items()), tokens, distinct, len(texts), sum(words.values()) + len(texts), len(words) + 1)


def test_all_tokens_are_trained_on(spark, monkeypatch):
    """Every token of short and long training documents counts, in shards and rounds alike, and none of those held out."""
    texts = [" ".join(f"w{(k * j) % 50}" for j in range(n)) for k, n in enumerate([1, 0, 63, 65, 300, 767, 2000, 16, 15, 17])]
    wanted = sum(len(t.split()) + 1 for k, t in enumerate(texts) if not lmscore.held_out(k))
    docs = documents(spark, list(enumerate(texts))).selectExpr("doc_id id", "text")
    shared = SimpleNamespace(value=statistics(texts))
    encoded = docs.mapInArrow(lmscore._encoded(shared), lmscore.ENCODED)
    start = gru.Model(shared.value.vocabulary).vector()
    part = encoded.where("not held").selectExpr("pmod(id, 3) shard", "symbols").repartition(2, "shard").sortWithinPartitions("shard")
    rows = part.mapInArrow(lmscore._trained(SimpleNamespace(value=(shared.value, start))), "piece int, shard long, weight double, v binary").collect()
    assert {r.shard for r in rows} == {0, 1, 2} and len(rows) == 3 * lmscore.PIECES
    assert sum(r.weight for r in rows if r.piece == 0) == wanted
    trained = []
    real = lmscore._trained
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", 600)
    monkeypatch.setattr(lmscore, "_trained", lambda shared: trained.append(1) or real(shared))
    lmscore.fit(encoded, shared.value)
    assert len(trained) == lmscore.ROUNDS


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """The same table in 2 and in 8 partitions, in other orders, dealt into several shards: the same scores."""
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({r.doc_id: r for r in lmscore.score(docs.repartition(n, F.xxhash64("text", F.lit(n)))).collect()} for n in (2, 8))
    assert a.keys() == b.keys()
    assert all(abs(a[k].score - b[k].score) <= 1e-5 * abs(a[k].score) and a[k].base_score == pytest.approx(b[k].base_score) for k in a)


def test_state_goes_from_window_to_window(monkeypatch):
    seen, calls = [], []
    model = gru.Model(statistics(["a b c d e"]).vocabulary)
    real = gru.Model._window

    def window(self, x, y, valid, h, full):
        seen.extend(zip(x[valid].tolist(), y[valid].tolist()))
        out = real(self, x, y, valid, h, full)
        calls.append((h, out))
        return out

    monkeypatch.setattr(gru.Model, "_window", window)
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(1, 130, n), 0) for n in (40, 0, 15, 16, 100)]
    assert model.train(texts, 2) == sum(map(len, texts))
    assert Counter(seen) == Counter(p for t in texts for p in zip([0, *t[:-1].tolist()], t.tolist()))
    seen.clear(), calls.clear()
    model.train(texts[:1], 1)
    assert not calls[0][0].any() and all((a[1] == b[0]).all() and b[0].any() for a, b in zip(calls, calls[1:]))


def test_states_end_with_their_text():
    """A text after another one in a lane is read as it would be alone."""
    model = gru.Model(statistics(["a b c d e"]).vocabulary)
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(1, 130, n), 0) for n in (9, 0, 30, 5)]
    together = model._forward(np.concatenate([[0], *texts])[:-1, None].astype(np.intp), np.ones((1, gru.UNITS), np.float32))
    alone = [model._forward(np.concatenate(([0], t))[:-1, None].astype(np.intp), np.zeros((1, gru.UNITS), np.float32)) for t in texts]
    assert np.allclose(together, np.concatenate(alone))


def plain_shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {""}


def test_near_duplicate_stage_against_all_pairs(spark, monkeypatch):
    """Edited copies around 0.8, a large group with a common line, short and blank texts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    common = " ".join(f"licence{k}" for k in range(12))
    texts = ["", "  ", "one two", "One  two", "one two three"]
    for k in range(40):
        base = [word() for _ in range(rng.choice([6, 60, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(12)):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 50)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + common if k % 3 else ""))
    rng.shuffle(texts)
    sets = [plain_shingles(t) for t in texts]
    true = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = groups(len(sets), true)
    assert 60 < len(set(want)) < len(want) - 40
    monkeypatch.setattr(neardup, "LARGE", 8)
    df = documents(spark, list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == set(want)


def test_tokenizer_tables_go_when_another_stage_starts():
    """Python workers are reused: the tokenizer's tables stay from task to task, and no longer than its stage."""
    arguments = (public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN, bpe.SMALL)
    encoder = weakref.ref(bpe._encoder(*arguments))
    assert bpe._encoder(*arguments) is encoder()
    assert [len(b) for b in neardup._keys([pa.RecordBatch.from_pydict({"text": ["one two three"]})])] == [1]
    assert encoder() is None
    assert bpe._encoder(*arguments).encode("one two")


def test_quality_leaves_no_words_in_workers(spark):
    """A task's end empties the table of its process, not a copy that came with the task."""
    df = documents(spark, [(k, f"some words {k} of a text") for k in range(64)]).repartition(4)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    quality.keep_selected(df, labels).collect()

    def left(batches):
        from quillstream.llm.quality import _hashes  # the process's own

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(_hashes)], pa.int64())})

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(left, "n long").collect()} == {0}


def test_near_duplicates_go_through_simhash(spark, monkeypatch):
    """The covering tables' links are those of all five-word fingerprints; what is linked equals brute force, borderline copies included."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(70)]
    texts = ["", "one two three"]
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(6)}"
        texts.append(" ".join(copy))
    for _ in range(10):
        long = [f"w{rng.randrange(3000)}" for _ in range(600)]
        texts += [" ".join(long), " ".join(long[:-1])]
    asked, covering = [], simhash.near_edges

    def seen(reps):
        asked.append({r.fp for r in reps.collect()})
        return covering(reps)

    monkeypatch.setattr(simhash, "near_edges", seen)
    pairs, alike = [], neardup._alike
    monkeypatch.setattr(neardup, "_alike", lambda nodes: (pairs.append(({r.node: r.fp for r in nodes.collect()}, alike(nodes))), pairs[0][1])[1])
    monkeypatch.setattr(neardup, "LARGE", 8)
    sets = [plain_shingles(t) for t in texts]
    true = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = groups(len(sets), true)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, list(enumerate(texts))), "").collect()}
    assert kept == set(want) and 20 < len(kept) < len(set(texts)) - 20
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert asked == [{simhash.signed(p) for p in prints}]
    of = {neardup.name_of(neardup.shingles(t)): k for k, t in reversed(list(enumerate(texts)))}
    near = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS]
    linked = [(of[r.a], of[r.b]) for r in pairs[0][1].collect()]
    equal = [(of[neardup.name_of(neardup.shingles(t))], k) for k, t in enumerate(texts)]
    assert len(linked) > 10 and groups(len(texts), linked + equal) == groups(len(texts), near)


def test_near_copies_of_one_text_meet_in_few_pairs(spark, monkeypatch):
    """A large group whose members differ from their original, or share a passage, and are mostly not similar: linked as by brute force, without all its pairs."""
    rng = random.Random(21)
    base, passage = [[f"{p}{k}" for k in range(n)] for p, n in (("b", 146), ("p", 60))]
    fresh = lambda: f"f{rng.randrange(10**9)}"
    texts = []
    for k in range(400):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 4, 5])):
            copy[rng.randrange(146)] = fresh() if k % 5 else f"b{rng.randrange(146)}"
        texts.append(" ".join(copy))
    for _ in range(200):
        texts.append(" ".join([fresh() for _ in range(rng.randrange(1, 15))] + passage + [fresh() for _ in range(rng.randrange(15))]))
    sets = [plain_shingles(t) for t in texts]
    true = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = groups(len(sets), true)
    assert 100 < len(set(want)) < 500
    asked, possible = [], neardup._possible

    def seen(pairs, nodes):
        asked.append(pairs.count())
        return possible(pairs, nodes)

    monkeypatch.setattr(neardup, "_possible", seen)
    df = documents(spark, list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(want))
    assert sum(asked) < 10 * len(texts)
