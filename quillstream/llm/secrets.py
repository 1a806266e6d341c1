"""Secret scans: fixed formats, and a log-likelihood ratio of two character models.

The formats are found by pattern.  Further tokens are found by the method: one
character Markov model is trained on labelled random strings, one on labelled
ordinary words and identifiers, and a long token is a secret if the first
explains it better than the second by a margin calibrated on held-out labelled
samples.  Both samples are fixed by a seed and a public vocabulary file, so a
text is judged alike in every corpus.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import id_and_text, small_batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Tokens that the models judge.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: Rank file whose tokens of letters are the ordinary words, and how many samples each way of joining them gives.
WORDS, JOINED = "byte_bpe_multi_50k.tiktoken", 6_000
#: Random strings in the labelled sample.
RANDOM_SAMPLES = 6_000

CLASSES = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"


def random_strings(n: int = RANDOM_SAMPLES, seed: int = 7) -> list[str]:
    """Labelled positives: keys and digests in the usual alphabets."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-")
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randrange(20, 65))) for k in range(n)]


def identifiers(path: str | None = None, seed: int = 11) -> list[str]:
    """Labelled negatives: the ordinary words of a vocabulary file, alone and joined as names, paths and compounds are."""
    tokens = (t.removeprefix(b" ") for t in load_ranks(path or public_tokenizers.path(WORDS)))
    words = sorted({t.decode() for t in tokens if len(t) > 2 and t.isalpha() and t.isascii()})
    rng = random.Random(seed)
    some = lambda low, high: rng.choices(words, k=rng.randrange(low, high))
    digits = lambda low, high: "".join(rng.choices(string.digits, k=rng.randrange(low, high)))
    out = list(words)
    for _ in range(JOINED):
        out.append(rng.choice("_-/=+").join(some(2, 7)))
        out.append(rng.choice(["", "_"]).join(some(2, 5)).lower())
        out.append(rng.choice(["", "s"]).join(w.lower() for w in some(2, 5)).capitalize())
        out.append("".join(w.title() for w in some(2, 6)))
        out.append("_".join(some(2, 5)).upper())
        out.append(f"{'_'.join(some(1, 4))}{rng.choice('_-')}{digits(1, 5)}")
        out.append(digits(10, 30))
        out.append(f"20{digits(2, 3)}-{digits(2, 3)}-{digits(2, 3)}-{'-'.join(some(1, 5))}")
    alphabets = (string.ascii_lowercase, string.ascii_uppercase, string.digits + "abcdef", string.ascii_letters + string.digits)
    out += [(a * 3)[k : k + size] for a in alphabets for k in range(len(a)) for size in (20, 26, 32)]
    return out + [c * k for c in "-_=+/" for k in (20, 24, 32, 48, 64, 80) for _ in range(20)]


def _codes(text: str) -> np.ndarray:
    return CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


#: Byte to character class; all that no candidate holds is the last.
CODE = np.full(256, len(CLASSES), np.int64)
for _k, _c in enumerate(CLASSES):
    CODE[ord(_c)] = _k
SIZE = len(CLASSES) + 2  # and the beginning


class Markov:
    """Order-2 character model, interpolated with orders 1 and 0."""

    def __init__(self, samples: Iterable[str]):
        lead = np.array([SIZE - 1, SIZE - 1])
        c = np.concatenate([lead, *(x for s in samples for x in (_codes(s), lead))])
        first, second, third = c[:-2], c[1:-1], c[2:]
        inside = third < SIZE - 1
        three = np.bincount((first * SIZE + second)[inside] * SIZE + third[inside], minlength=SIZE**3).reshape(SIZE * SIZE, SIZE)
        two = three.reshape(SIZE, SIZE, SIZE).sum(0)
        one = two.sum(0) + 1.0
        p = one / one.sum()
        p2 = (two + 4 * p) / (two.sum(1, keepdims=True) + 4)
        self.log = np.log((three + 8 * np.tile(p2, (SIZE, 1))) / (three.sum(1, keepdims=True) + 8)).astype(np.float32)

    def score(self, text: str) -> float:
        c = np.concatenate(([SIZE - 1, SIZE - 1], _codes(text)))
        return float(self.log[c[:-2] * SIZE + c[1:-1], c[2:]].sum())


class Detector:
    """Both models and the margin that a token must exceed."""

    def __init__(self, random_tokens: list[str], ordinary: list[str], false_rate: float = 1e-3):
        held = [s for k, s in enumerate(ordinary) if k % 5 == 0]
        self.noise = Markov(s for k, s in enumerate(random_tokens) if k % 5)
        self.plain = Markov(s for k, s in enumerate(ordinary) if k % 5)
        long = sorted((self.ratio(s) for s in held if len(s) >= 16), reverse=True)
        #: Nats per character that at most false_rate of held-out long identifiers exceed, and never under 0.3.
        self.margin = max(0.3, long[min(len(long) - 1, math.ceil(false_rate * len(long)))] if long else 0.3)
        self.recall = float(np.mean([self.is_secret(s) for k, s in enumerate(random_tokens) if k % 5 == 0] or [0]))

    def ratio(self, token: str) -> float:
        return (self.noise.score(token) - self.plain.score(token)) / len(token)

    def is_secret(self, token: str) -> bool:
        return self.ratio(token) > self.margin


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], detector: Detector) -> list[tuple[int, int, int]]:
    """Tokens that the models call random and that no base span touches; base is sorted."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a and detector.is_secret(m[0]):
            out.append((a, 3, b))
    return out


def _joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


@lru_cache(maxsize=2)
def train(path: str | None = None) -> Detector:
    """Both models from the labelled samples: seeded random strings, and the words of a vocabulary file."""
    return Detector(random_strings(), identifiers(path))


def find_secrets(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text.

    Returns ``id_col``, ``found`` (array of struct kind, start, end, score; code
    points, end exclusive; sorted by start and kind), ``base`` and ``spans``
    (the base spans, and all, as kind:start:end joined by commas), a row for
    each row.  A null text counts as empty; a null key stays null; repeated rows
    stay; an empty table gives an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector or train())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found, base, every = [], [], []
            for text in batch.column(1).to_pylist():
                fixed = base_spans(text)
                more = added_spans(text, fixed, models)
                both = sorted(fixed + more)
                found.append([{"kind": KINDS[k], "start": a, "end": b, "score": models.ratio(text[a:b])} for a, k, b in both])
                base.append(_joined(fixed))
                every.append(_joined(both))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(base, pa.string()), pa.array(every, pa.string())], ["id", "found", "base", "spans"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, found array<struct<kind:string,start:long,end:long,score:double>>, base string, spans string")
    return out.withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind of the base spans, their digest, all spans, and the count of those that the models add."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS[:-1]],
        F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"),
        "spans",
        count(KINDS[-1]).alias(f"n_{KINDS[-1]}"),
    )
