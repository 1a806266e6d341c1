import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstream.llm import capfilters, components, queries, simhash

from .tables import clashing, documents, empty_documents, odd_documents

D = "/root/testdata/sf0.001"


def groups(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)], [(3, 3), (5, 9), (9, 5), (9, 2), (7, 8)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    out = {r.node: r.component for r in components.connected_components(df).collect()}
    want = groups(100, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {x: want[x] for x in linked}


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["A", "bÉ", "c c", "Zz"]) for _ in range(n)).replace("Zz ", "Zz\n\t")
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover():
    """Every set of up to three bits is ignored by some table, at every level below too."""
    masks = simhash._levels()[0]
    assert len(masks) == 15
    rng = random.Random(5)
    for level in simhash._levels()[:2]:
        for _ in range(300):
            bits = rng.sample(range(64), 3)
            assert any(not any(m >> b & 1 for b in bits) for m in level)


def fingerprint_table(spark, values):
    return spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "rep long, fp long")


def test_near_edges_lose_nothing(spark, monkeypatch):
    """Against all pairs; a low bound makes buckets be covered again, down to the last level."""
    monkeypatch.setattr(simhash, "LARGE", 4)
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    while len(values) < 400:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    base = rng.getrandbits(64)
    for k in range(12):  # a chain, three bits a step
        base ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.add(base)
    values = sorted(values)
    found = [(r.a, r.b) for r in simhash.near_edges(fingerprint_table(spark, values)).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in found)
    true = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    assert groups(len(values), found) == groups(len(values), true)


def test_simhash_odd_rows(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicates(clashing(docs)).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == by[9] == {("0" * 16, 2)}
    assert {c for _, c in by[7]} == {1} and {c for _, c in by[None]} == {None}
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "5", "6", "8", "None"])
    assert simhash.keep_one(empty_documents(spark)).count() == 0


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op7_simhash(spark, D).collect()}
    keys = sorted(texts)
    prints = [plain_fingerprint(texts[k]) for k in keys]
    assert [rows[k].fingerprint for k in keys] == [f"{p:016x}" for p in prints]
    edges = [(a, b) for a in range(len(keys)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert [rows[k].component_id for k in keys] == [keys[g] for g in groups(len(keys), edges)]


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_links(rows, threshold=0.98):
    good = {}
    for k, v, label in rows:
        if k is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[k] = (np.array(v, np.float32).astype(float), label)
    keys = sorted(good)
    edges = []
    for i, a in enumerate(keys):
        for j in range(i):
            (x, lx), (y, ly) = good[a], good[keys[j]]
            if lx == ly and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                edges.append((i, j))
    component = groups(len(keys), edges)
    return {k: (sum(i in e for e in edges), keys[component[i]]) for i, k in enumerate(keys)}


def test_vectors(spark, monkeypatch):
    """Clusters, copies, small chunks, odd vectors, other lengths: against all pairs."""
    monkeypatch.setattr(capfilters, "CHUNK", 8)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        rows.append((k, rng.standard_normal(16).tolist(), int(k % 3)))
    for c in range(6):
        centre = rng.standard_normal(16)
        for k in range(25):
            rows.append((1000 + 100 * c + k, (centre + 0.06 * rng.standard_normal(16)).tolist(), c % 2))
    same = rng.standard_normal(16).tolist()
    rows += [(3000 + k, same, 1) for k in range(40)] + [(4000, [2 * x for x in same], 1), (4001, same, 2)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1), (5004, same, None), (5005, [], 1), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1), (5008, [float("inf")] * 16, 1), (5009, [-0.0, 1.0], 2), (5010, [0.0, 1.0], 2)]
    rows += [(None, same, 1), (3000, same, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("rep", "vec", "id", "n", "f", "size")})
    out = capfilters.near_duplicates(df).collect()
    assert len(out) == len(rows)
    want = plain_links(dict.fromkeys([(k, None if v is None else tuple(v), lab) for k, v, lab in rows]))
    for r in out:
        if r.vec_id in want:
            assert (r.n_links, r.component_id) == want[r.vec_id], r
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert capfilters.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    want = plain_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in queries.op9_cap_filters(spark, D).collect()} == want


def test_repeated_documents(spark):
    docs = documents(spark, [(k, "one two three four five six") for k in range(20)] + [(99, "quite another text of some words")])
    assert {r.component_id for r in simhash.near_duplicates(docs).where("doc_id < 20").collect()} == {0}
