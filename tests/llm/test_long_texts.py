"""Long texts with many matches, and spans planted in the driver's own texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, pii

from .tables import documents
from .test_scans import plain_overlaps, plain_personal

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trees(spark):
    return pii.train(spark)


def plain_clear(cands, base):
    apart = lambda b, c: b[1] <= c[0] or c[1] <= b[0]
    wider = lambda b, c: c[2] and c[0] <= b[0] and b[1] <= c[1] and c[1] - c[0] > b[1] - b[0]
    return [c for c in cands if all(apart(b, c) or wider(b, c) for b in base)]


def test_candidates_against_base_spans(spark):
    """The walk over ends against every pair, with spans that touch, hold, cross and equal each other."""
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        spans = lambda n: sorted((a := rng.randrange(30), a + rng.randrange(1, 8)) for _ in range(rng.randrange(n)))
        rows.append((spans(8), [(a, b, rng.random() < 0.5) for a, b in spans(6)]))
    data = [([(s, 0, e) for s, e in base], [(s, -e, w) for s, e, w in sorted(cands, key=lambda c: (c[0], -c[1]))]) for base, cands in rows]
    df = spark.createDataFrame(data, "base array<struct<s:bigint,k:int,e:bigint>>, high array<struct<s:bigint,n:bigint,word:boolean>>")
    found = pii._with_clear(df).collect()
    assert [[(c.s, -c.n, c.word) for c in r.good] for r in found] == [plain_clear([(c.s, -c.n, c.word) for c in r.high], [(b.s, b.e) for b in r.base]) for r in found]


def test_many_matches_take_linear_time(spark, trees):
    """Two million characters of addresses and phone numbers in one text, found and redacted."""
    took = []
    for n in (1, 11_000, 44_000):
        text = " ".join(f"mail a{k}@b{k}.com or +49 30 12345{k % 90 + 10} now" for k in range(n))
        df = documents(spark, [(1, text)])
        began = time.time()
        row = pii.digests(pii.find_personal(df, trees)).first()
        assert (row.n_email, row.n_phone) == (n, n)
        assert pii.redact(df, trees).first().text == " ".join(["mail [EMAIL] or [PHONE] now"] * n)
        took.append(time.time() - began)
    assert len(text) > 1_900_000 and took[2] < 8 * took[1] + 5


def test_redacted_pieces_across_blocks(spark, trees):
    text = "é😀" * 700 + " a@b.com " + "x" * 5000 + "\n10.0.0.1 ü " + "y " * 900 + "+49 30 1234567"
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in plain_personal(text).split(",")))
    want, at = "", 0
    for a, b, k in spans:
        want, at = want + text[at:a] + f"[{k.upper()}]", b
    assert pii.redact(documents(spark, [(1, text)]), trees).first().text == want + text[at:]


def test_planted_personal_data(spark, trees):
    """Data of every kind planted in the driver's texts: all found, and hardly anything else."""
    rng = random.Random(6)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").where("text is not null").collect()]
    digit = lambda n: "".join(rng.choices("0123456789", k=n))
    kinds = {
        "email": lambda: f"j{digit(2)}.doe@mail{digit(1)}.org", "ip": lambda: "10.20.30.4" + digit(1), "phone": lambda: f"+49 30 {digit(7)}",
        "spelled": lambda: f"max{digit(2)} [at] firma [dot] de", "accented": lambda: f"jörg{digit(2)}.meyer@firma.de", "local": lambda: f"Tel: (0{digit(2)}) {digit(3)}-{digit(4)}",
    }
    texts, planted = [], {}
    for k, (own, text) in enumerate(docs):
        words = re.split(r"(\s+)", text)
        kind = list(kinds)[k % len(kinds)]
        at = 2 * rng.randrange(len(words) // 2 + 1)
        before, what = "".join(words[:at]).rstrip(), kinds[kind]()
        lead = f"{before} write to " if kind != "local" else f"{before} "
        shown = what.removeprefix("Tel: ")
        planted[own] = (kind, len(lead) + len(what) - len(shown), len(lead) + len(what))
        texts.append((own, lead + what + " " + "".join(words[at:]).lstrip()))
    spans = lambda rows: {r.doc_id: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in pii.digests(pii.find_personal(documents(spark, rows), trees)).collect()}
    plain, found = spans(docs), spans(texts)
    recall, extra = {k: [0, 0] for k in kinds}, 0
    for own, (kind, a, b) in planted.items():
        recall[kind][1] += 1
        recall[kind][0] += any(s <= a and e >= b for _, s, e in found[own])
        extra += sum(e <= a or s >= b for _, s, e in found[own]) - len(plain[own])
    rates = {k: hit / n for k, (hit, n) in recall.items()}
    assert min(rates.values()) >= 0.9, rates
    assert extra <= 0.02 * len(docs)


def test_stretches_across_pieces(spark, monkeypatch):
    """Items at every place around the ends of pieces, by both ways of meeting."""
    monkeypatch.setattr(decontaminate, "PIECE", 32)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((20, 13, 9, 6, 3))]
    docs = []
    for at in range(12, 72, 3):
        for k, text in items:
            v = text.split()
            if len(v) > 5:
                v[rng.randrange(len(v))] = "other"
            docs.append((len(docs), " ".join([word() for _ in range(at)] + v + [word() for _ in range(rng.randrange(40))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_overlaps(docs, items)
    assert len(want) == len(docs)
    for bound in (50_000, 1):
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", bound)
        assert {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(documents(spark, docs), bench).collect()} == want


def test_long_documents_of_benchmark_words(spark):
    """A document of a megabyte in benchmark words takes about as long a word as one of an eighth."""
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    words = " ".join(r.text for r in bench.where(F.col("text").isNotNull()).collect()).split()
    took = []
    for n in (100, 25_000, 200_000):
        df = documents(spark, [(1, " ".join((words * (n // len(words) + 1))[:n]))])
        began = time.time()
        assert decontaminate.overlaps(df, bench).count() > 0
        took.append(time.time() - began)
    assert took[2] < 12 * took[1] + 5


def test_places_carry_only_words_around_them(spark, monkeypatch):
    """Rows of places hold the words that a stretch with their seed can reach, not their piece, at the ends of pieces too."""
    monkeypatch.setattr(decontaminate, "PIECE", 32)
    words = [f"w{k}" for k in range(100)]
    df = documents(spark, [(1, " - ".join(words)), (2, " w0, w1 ")]).select(F.col("doc_id").alias("id"), decontaminate.words_of(F.col("text")).alias("w"))
    rows = decontaminate._doc_seeds(decontaminate._pieces(df), {(0, 1): 0}, None).collect()
    assert sorted((r.id, r.p) for r in rows) == [(1, k) for k in range(99)] + [(2, 0)]
    for r in rows:
        have = words if r.id == 1 else words[:2]
        first = max(0, r.p - decontaminate.BEFORE)
        assert r.near == have[first : r.p + decontaminate.AFTER] and r.p - r.own == first
