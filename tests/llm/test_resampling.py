"""Exact duplicates, importance resampling and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import exacthash, importance, trie

from .tables import clashing, documents, empty_documents, odd_documents


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_groups(rows):
    of = defaultdict(list)
    for k, t in rows:
        of[lowered(t)].append(k)
    out = []
    for k, t in rows:
        group = of[lowered(t)]
        keep = max((g for g in group if g is not None), default=None)
        out.append((k, keep, len(group), k == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def text_rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("bits", "capacity"), [(64, 4096), (64, 2), (3, 2), (1, 1)])
def test_exact_duplicates_with_collisions(spark, bits, capacity):
    rng = random.Random(3)
    texts = ["", None, "A", "a", "É", "é", "a ", "same text"] + ["".join(rng.choices("abAB", k=3)) for _ in range(60)]
    df = documents(spark, [(k, rng.choice(texts)) for k in range(400)]).repartition(5)
    assert collected(exacthash.exact_duplicates(df, bits=bits, capacity=capacity)) == plain_groups(text_rows(df))


def test_exact_duplicates_of_odd_documents(spark):
    df = clashing(odd_documents(spark))
    assert collected(exacthash.exact_duplicates(df)) == plain_groups(text_rows(df))
    assert exacthash.exact_duplicates(empty_documents(spark)).collect() == []
    kept = exacthash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [4, 5, 6, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 1


def test_directory_doubles_and_splits():
    rng = np.random.default_rng(1)
    prefixes = Counter((rng.beta(0.5, 3, 5000) * 256).astype(int).tolist())
    d = exacthash.grow(dict(prefixes), 8, 40)
    assert len(d.slots) == 1 << d.depth and max(d.local) == d.depth
    assert sum(d.sizes) == 5000 and sorted(set(d.slots)) == list(range(len(d.sizes))) == sorted(range(len(d.local)))
    for number, (local, size) in enumerate(zip(d.local, d.sizes)):
        slots = [k for k, b in enumerate(d.slots) if b == number]
        assert len(slots) == 1 << (d.depth - local) and slots == list(range(slots[0], slots[0] + len(slots)))
        assert size == sum(prefixes[p] for p in range(slots[0] << (8 - d.depth), (slots[-1] + 1) << (8 - d.depth)))
        assert size <= 40 or local == 8
    owners = d.owners(6)
    assert owners == sorted(owners) and max(owners) < 6
    assert exacthash.grow({}, 0, 10).slots == (0,)


def test_index_entries_are_whole(spark):
    df = documents(spark, [(k, f"text {k % 300}") for k in range(900)])
    index = exacthash.build(df, capacity=16)
    rows = index.entries.collect()
    assert len(rows) == 300 == len({r.key for r in rows}) and {r.group_size for r in rows} == {3}
    for r in rows:
        assert r.bucket == index.directory.slots[(r.key & (2**64 - 1)) >> (64 - index.directory.depth)]
    assert max(Counter(r.bucket for r in rows).values()) <= 16


def plain_draw(rows, target, percent=10, least=20, seed=2024, k=10_000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    bucket = lambda w: crc32(w.encode()) % k
    s, t = Counter(bucket(w) for _, x in rows for w in words(x)), Counter(bucket(w) for x in target for w in words(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + k) / ((s[b] + 1) * (t.total() + k))))
    out = []
    for own, x in rows:
        features = [bucket(w) for w in words(x)]
        weight = sum(map(gain, features))
        h = int(hashlib.sha256(f"{seed}:{'null' if own is None else own}".encode()).hexdigest()[:8], 16)
        out.append([own, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for at, r in enumerate(long[: percent * len(long) // 100]):
        r[4] = at + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_against_plain_version(spark):
    rng = random.Random(4)
    words = ["sun", "Moon", "étoile", "x1", "日本", "the", "THE", "don't"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(60)))) for k in range(300)]
    target = ["the moon and the étoile", None, "", "Sun sun"]
    df, aim = documents(spark, rows).repartition(7), documents(spark, list(enumerate(target)))
    for percent, least in ((10, 20), (100, 0), (37, 5), (0, 1)):
        assert collected(importance.resample(df, aim, percent=percent, least_words=least)) == plain_draw(rows, target, percent, least)


def test_resampling_odd_documents(spark):
    df = clashing(odd_documents(spark))
    assert collected(importance.resample(df, df, percent=100, least_words=1)) == plain_draw(text_rows(df), [t for _, t in text_rows(df)], 100, 1)
    assert importance.resample(empty_documents(spark), df).collect() == []
    assert collected(importance.resample(df, empty_documents(spark))) == plain_draw(text_rows(df), [])


def test_streams_hold_every_bucket_and_offset(spark, monkeypatch):
    rows = [(1, "b a a"), (2, None), (3, "A"), (4, "")]
    packed = importance.streams(documents(spark, rows).coalesce(1), "doc_id", "text").collect()
    assert len(packed) == 1 and packed[0].ids == [1, 2, 3, 4] and packed[0].offsets == [0, 3, 3, 4, 4]
    a, b = crc32(b"a") % 10_000, crc32(b"b") % 10_000
    assert np.frombuffer(packed[0].stream, "<u2").tolist() == [b, a, a, a]
    at, n = importance.run_lengths(packed[0].stream)
    assert dict(zip(at.tolist(), n.tolist())) == {a: 3, b: 1}
    assert importance.weights(packed[0].stream, np.array(packed[0].offsets), np.arange(10_000)).tolist() == [b + 2 * a, 0, a, 0]
    assert importance.buckets_of(b"x y z", 10_000, 2).tolist() == [crc32(w) % 10_000 for w in (b"x", b"y", b"z", b"x y", b"y z")]
    with pytest.raises(ValueError):
        importance.streams(documents(spark, rows), "doc_id", "text", 70_000)


def test_long_documents_have_streams_of_their_own():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"w " * (1 << 20), b"w", b"w"])], ["id", "text"])
    sizes = [[len(i.as_py()) for i in b.column(0)] for b in importance._packed(10_000, 1)([batch])]
    assert sizes == [[1], [2]]


CONV = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for path in nodes:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    kids = Counter(path[:-1] for path in nodes if path)
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below[path] if p)
        leaves = sum(kids[p] == 0 for p in below[path])
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids[path], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n):
    """Turns of few kinds, so that many conversations share beginnings, are copies or parts of others; some turns without number, role or text."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn if rng.random() > 0.05 else None, rng.choice(["user", "user", None, ""]), rng.choice(["hé", "hé", "hé", "yes", None]) if turn else "hello"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "small"), [(1, 60, 256), (2, 60, 1), (3, 120, 4), (4, 5, 256)])
def test_trie_against_plain_version(spark, seed, n, small):
    rows = conversations(seed, n)
    df = spark.createDataFrame(rows, CONV).repartition(3)
    assert collected(trie.prefix_trie(df, small)) == plain_trie(rows)


def test_trie_of_odd_conversations(spark):
    rows = [(None, 1, "user", "nobody"), (10, None, None, None), (10, None, None, None), (11, 5, "user", "x" * 50_000), (12, 5, "user", "x" * 50_000), (13, 1, "", ""), (13, 1, "a", "b"), (13, 1, "a", "a")]
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("clash") for c in ("conv", "depth", "node", "name", "bytes", "n", "weight")})
    assert collected(trie.prefix_trie(df)) == plain_trie(rows)
    assert trie.prefix_trie(spark.createDataFrame([], CONV)).collect() == []


def test_trie_of_one_and_of_copies(spark):
    one = [(5, t, "user", f"t{t}") for t in range(4)]
    assert collected(trie.prefix_trie(spark.createDataFrame(one, CONV))) == plain_trie(one)
    copies = [(c, t, "user", f"t{t}") for c in range(0, 3000, 5) for t in range(3)]
    for small in (1, 256):
        assert collected(trie.prefix_trie(spark.createDataFrame(copies, CONV), small)) == plain_trie(copies)
