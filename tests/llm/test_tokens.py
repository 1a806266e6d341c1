import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from quillstream.llm import bpe, queries, tokencount

from .tables import LONG, clashing, empty_documents, odd_documents

RANKS, PIECES = P.path(queries.RANKS), P.path(queries.PIECES)
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@pytest.mark.parametrize("states", [50, 120_000])
def test_encoder_agrees(reference, monkeypatch, states):
    """Also where states are dropped all the time because few are kept."""
    monkeypatch.setattr(bpe, "MAX_STATES", states)
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    rng = random.Random(1)
    for alphabet in (" \n\t\r\x0b\x1c\x85\xa0ab'sTé日本😀0１²ª_-.…́", "abcdeeilnorst'0 ", "the re and of\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert ids(encoder, text) == reference.encode_ordinary(text), text
    for text in (LONG, "a" * 3000, " " * 3000 + "x", "ab" * 2000, "\n \n b", "x  y", "日本" * 1000, "don't I'll"):
        assert ids(encoder, text) == reference.encode_ordinary(text)
        assert "".join(encoder.decode(encoder.encode(text))) == text


def test_lookahead_is_bounded(spark, reference):
    """All pre-tokens of the driver's texts go through the states, and what is certain is emitted after few bytes."""
    machine = bpe.Transducer(bpe.load_ranks(RANKS))
    pattern, pieces = bpe.regex.compile(P.PATTERN), set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        pieces.update(pattern.findall(r.text or ""))
    pieces = sorted(p.encode() for p in pieces if p.encode() not in machine.ranks)
    for p in pieces:
        assert machine.encode(p) == reference._encode_bytes(p)
    assert not machine.dropped and max(machine.behind) <= max(map(len, machine.ranks))
    before = machine.made
    assert all(machine.encode(p) == reference._encode_bytes(p) for p in pieces) and machine.made == before  # every transition was kept


def test_border_rule_is_that_of_the_merges():
    ranks = bpe.load_ranks(RANKS)
    machine, rng = bpe.Transducer(ranks), random.Random(3)
    short = [i for i, b in machine.token.items() if len(b) < 4]
    for k in range(6000):
        left, right = rng.choice(short if k % 2 else list(machine.token)), rng.choice(short)
        pair = [machine.token[left], machine.token[right]]
        assert machine._compatible(left, right) == (bpe.merge_plain(ranks, b"".join(pair)) == pair)


def test_words_are_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    text = " ".join(f"word{k % 17}, x{k}" for k in range(200))
    assert ids(encoder, text) == reference.encode_ordinary(text)
    assert len(encoder.inner) <= 6


def test_utf8_stream():
    rng = random.Random(2)
    for _ in range(5000):
        data = bytes(rng.choice([rng.randrange(256), rng.choice("€😀é".encode() + b"\xed\xa0")]) for _ in range(rng.randrange(14)))
        stream, at, out = bpe.Utf8Stream(), 0, ""
        while at < len(data):
            step = rng.randrange(1, 5)
            out += stream.feed(data[at : at + step])
            at += step
        assert out + stream.close() == data.decode("utf-8", "replace")


def test_encode_odd_rows(spark, reference):
    docs = odd_documents(spark)
    rows = bpe.encode_decode(clashing(docs), RANKS, P.PATTERN).collect()
    assert len(rows) == docs.count()
    want = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == want
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.decoded)
    assert bpe.digests(bpe.encode_decode(empty_documents(spark), RANKS, P.PATTERN)).count() == 0


def test_query_against_library(spark, reference):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = queries.op2_byte_bpe(spark, D).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_counts_agree():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = tokencount.Counter(PIECES)
    assert all(len(model.encode(w)) == 1 for w in list(counter.single)[::50])
    rng = random.Random(3)
    for alphabet in (" \n\tab'sTé日本😀0１▁<s>/", "the of and to  "):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
            assert counter.count(text) == len(model.encode(text)), repr(text)
    for text in (LONG, "a" * 3000, " " * 100, "▁▁ x", "</s><unk>"):
        assert counter.count(text) == len(model.encode(text))


def test_counts_are_bounded(monkeypatch):
    counter = tokencount.Counter(PIECES)
    monkeypatch.setattr(tokencount, "MAX_WORDS", len(counter) + 5)
    assert counter.count(" ".join(f"zq{k}zq" for k in range(100))) == len(counter.model.encode(" ".join(f"zq{k}zq" for k in range(100))))
    assert len(counter) <= len(counter.single) + 6


def test_count_odd_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = odd_documents(spark)
    rows = tokencount.count_tokens(clashing(docs), PIECES, limit=20).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in rows)
    assert tokencount.count_tokens(empty_documents(spark), PIECES).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert all(r.n_tokens == len(model.encode(texts[r.doc_id])) for r in queries.op6_token_counts(spark, D).collect())
