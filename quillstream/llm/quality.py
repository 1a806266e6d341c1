"""Quality by importance resampling over hashed n-grams.

Generative models over hashed unigrams and bigrams are fitted for target text
(labelled good and not toxic) and for raw text.  Raw text is modelled as what it
is, a mixture of documents of several kinds: target, low quality, toxic.  Each
kind has an n-gram model of its own, smoothed by the counts of all documents,
and the share that it has among labelled rows.  A document's importance is the
ratio of its target likelihood to its raw likelihood.  Both are likelihoods of
the whole document, and the ratio never exceeds one over the share of target
text, so long documents can't outweigh others.  Gumbel noise on the log ratio
makes the k largest keys a sample without replacement in proportion to
importance (Xie et al., "Data Selection for Language Models via Importance
Resampling", 2023).

k is a parameter.  If it isn't given, it is the number of documents that the
mixture finds more likely target than not: as many as there is target text.  A
smaller k takes a random sample of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, own_tables, small_batches

#: Buckets of the hashed unigrams and bigrams.
UNIGRAMS, BIGRAMS = 1 << 18, 1 << 16
BUCKETS = UNIGRAMS + BIGRAMS
#: Labelled rows that the models may be fitted on, those with the smallest hashed keys.
MAX_LABELLED = 20_000
#: Share of its own count that each model gets as pseudo-counts from the raw one.
TO_RAW = 0.005
#: Toxic text is target text in which one n-gram in so many (each rate as likely) comes from the toxic ones:
#: those that exceed the target by so many deviations in labelled toxic text, seen so often at least.
RATES, DEVIATIONS, LEAST_SEEN = (1 / 100, 1 / 400), 6.0, 8
TARGET, LOW, TOXIC, RAW = range(4)
#: Keys that may come to the driver when the cut between kept and dropped is found.
MAX_KEYS = 5_000
WORD = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Tokens to 32-bit hashes."""

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = zlib.crc32(token.lower().encode() if token.islower() or not token.isupper() or len(token) < 2 else b"^" + token.lower().encode())
        if len(token) < 64:
            self[token] = h
        return h


_hashes = _Hashes()


def forget() -> None:
    """Empty this process's table; what Spark sends with a task's function would be a copy of it."""
    _hashes.clear()


def features(text: str) -> np.ndarray:
    """Bucket of each unigram and bigram; a word followed by itself is one feature for all words."""
    tokens = WORD.findall(text)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint32, len(tokens))
    a, b = h[:-1], h[1:]
    pair = np.where(a == b, np.uint32(0x5BD1E995), (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (b >> np.uint32(15)))
    one = (h ^ (h >> np.uint32(18))) & np.uint32(UNIGRAMS - 1)
    two = ((pair ^ (pair >> np.uint32(16))) & np.uint32(BIGRAMS - 1)) + np.uint32(UNIGRAMS)
    return np.concatenate((one, two)).astype(np.int64)


@dataclass
class Models:
    """log p of each bucket by kind (target, low, toxic at each rate), and the kinds' shares of the raw text."""

    log_p: np.ndarray
    shares: np.ndarray

    def log_likelihoods(self, text: str) -> np.ndarray:
        f = features(text)
        ll = self.log_p[:, f].sum(1, dtype=np.float64)
        top = ll[TOXIC:].max()
        return np.array([ll[TARGET], ll[LOW], top + np.log(np.exp(ll[TOXIC:] - top).mean())])

    def log_ratio(self, ll: np.ndarray) -> np.ndarray:
        """log p_target - log p_raw, p_raw the mixture; ll: a row for each document."""
        mixed = ll + np.log(self.shares)
        top = mixed.max(1, keepdims=True)
        return ll[:, TARGET] - (top[:, 0] + np.log(np.exp(mixed - top).sum(1)))


def _labelled(labels: DataFrame) -> DataFrame:
    """At most MAX_LABELLED (id, kind), a bounded table that may be broadcast."""
    kind = F.when(F.col("quality") == 0, LOW).when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 1, TARGET)
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), kind.alias("kind")).where("label_id is not null and kind is not null")
    return rows.groupBy("label_id").agg(F.max("kind").alias("kind")).orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_LABELLED)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Bucket counts over all documents (raw) and the labelled ones (kinds), to smoothed models."""
    small_batches(docs.sparkSession)
    labelled = cut(_labelled(labels))
    kinds = {r.kind: r.n for r in labelled.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    read = id_and_text(docs, id_col, text_col).join(F.broadcast(labelled), F.col("id") == F.col("label_id"), "left").select("text", F.coalesce("kind", F.lit(RAW)).alias("kind"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("quality")
        counts = np.zeros((4, BUCKETS), np.int64)
        for batch in batches:
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = features(text)
                np.add.at(counts[RAW], f, 1)
                if kind != RAW:
                    np.add.at(counts[kind], f, 1)
        forget()
        where = np.flatnonzero(counts.any(0))
        for part in np.array_split(where, max(1, len(where) // 8192)):
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(counts[k, part]) for k in range(4))], ["bucket", "n0", "n1", "n2", "n3"])

    summed = read.mapInArrow(run, "bucket long, n0 long, n1 long, n2 long, n3 long").groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    counts = np.zeros((4, BUCKETS))
    found = summed.toArrow()  # at most BUCKETS rows
    for k in range(4):
        counts[k, found.column(0).to_numpy()] = found.column(k + 1).to_numpy()
    total = counts.sum(1)
    raw = (counts[RAW] + 0.1) / (total[RAW] + 0.1 * BUCKETS)
    drawn = lambda k: (counts[k] + (extra := TO_RAW * total[k] + 1) * raw) / (total[k] + extra)
    target, low = drawn(TARGET), drawn(LOW)
    expected = total[TOXIC] * target
    marked = (counts[TOXIC] >= LEAST_SEEN) & (counts[TOXIC] - expected > DEVIATIONS * np.sqrt(expected + 1))
    own = np.where(marked, counts[TOXIC] - expected, 0)
    own /= max(1.0, own.sum())
    toxic = [(1 - m) * target + m * own for m in RATES] if own.any() else [target] * len(RATES)
    # a kind without any text among the documents takes part in nothing
    shares = np.array([kinds.get(k, 0) * (total[k] > 0) for k in (TARGET, LOW, TOXIC)], float)
    if not shares[TARGET]:
        shares = np.array([1.0, 0, 0])
    shares = np.maximum(shares / shares.sum(), 1e-9)
    return Models(np.log(np.stack((target, low, *toxic))).astype(np.float32), shares)


def _likelihoods(docs: DataFrame, models: Models, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("quality")
        for batch in batches:
            ll = np.array([shared.value.log_likelihoods(t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(ll[:, k]) for k in range(3))], ["id", "l0", "l1", "l2"])
        forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, l0 double, l1 double, l2 double")


def _gumbel(seed: int, id_col: str) -> Column:
    """Standard Gumbel noise from the hashed key."""
    u = (F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _mixture(shares: np.ndarray) -> tuple[Column, list[Column]]:
    parts = [F.col(f"l{k}") + float(np.log(shares[k])) for k in range(3)]
    top = F.greatest(*parts)
    mixed = top + F.log(sum(F.exp(p - top) for p in parts))
    return mixed, [F.exp(p - mixed) for p in parts]


def _kth(keys: DataFrame, k: int) -> float:
    """The k-th largest key, by counts in ever narrower ranges; few keys come to the driver."""
    ends = keys.agg(F.min("key"), F.max("key")).first()
    low, high, above = ends[0], ends[1], 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        n = inside.count()
        if n <= MAX_KEYS or low == high:
            values = sorted((r.key for r in inside.select("key").distinct().limit(1) .collect()), reverse=True) if low == high else sorted((r.key for r in inside.select("key").collect()), reverse=True)
            return values[min(k - above, len(values)) - 1] if low != high else low
        step = (high - low) / 512
        if step == 0 or low + step == low:
            return low
        bins = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(511)).alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            n, lo, hi = bins[b]
            if above + n >= k:
                low, high = lo, hi
                break
            above += n


@dataclass
class Selection:
    """Fitted models, the keys of all documents and the key that the last kept one has."""

    models: Models
    keys: DataFrame
    cut_off: float
    seed: int


def select(docs: DataFrame, labels: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> Selection:
    """Fit, and find the cut of the Gumbel top-k; k: documents to keep, by default as many as are target rather than not."""
    models = fit(docs, labels, id_col, text_col)
    ll = cut(_likelihoods(docs, models, id_col, text_col))
    n = ll.count()
    mixed, posterior = _mixture(models.shares)
    if k is None:
        k = ll.agg(F.count_if(posterior[TARGET] >= 0.5)).first()[0]
    keys = ll.select("id", (F.col("l0") - mixed).alias("log_ratio")).withColumn("key", F.col("log_ratio") + _gumbel(seed, "id"))
    if not 0 < k < n:
        return Selection(models, keys, float("-inf") if k else float("inf"), seed)
    return Selection(models, keys, _kth(keys, k), seed)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The documents that the Gumbel top-k keeps: ``id_col``, ``log_ratio``, ``gumbel_key``, ``kept`` (true).

    ``k`` is the number of documents to keep; by default that of the documents
    that are target text rather than not.

    Null and blank texts have no n-gram and so the ratio 1; rows with the same
    key column share their noise, and rows that tie with the last kept one are
    all kept; a null key is a value like any other; without labelled target
    documents, or for an empty table, every row is kept; other columns are not read.
    """
    found = select(docs, labels, seed, id_col, text_col, k)
    return found.keys.where(F.col("key") >= found.cut_off).select(F.col("id").alias(id_col), "log_ratio", F.col("key").alias("gumbel_key"), F.lit(True).alias("kept"))


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The rows of docs, whole, that resample keeps; texts are scored again rather than shuffled."""
    found = select(docs, labels, seed, id_col, text_col, k)
    shared, cut_off = docs.sparkSession.sparkContext.broadcast(found.models), found.cut_off
    kept = docs.select("*", F.coalesce(F.col(text_col), F.lit("")).alias("__scored"), _gumbel(seed, id_col).alias("__noise"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("quality")
        for batch in batches:
            ll = np.array([shared.value.log_likelihoods(t) for t in batch.column(batch.num_columns - 2).to_pylist()]).reshape(-1, 3)
            key = shared.value.log_ratio(ll) + batch.column(batch.num_columns - 1).to_numpy()
            rows = batch.filter(pa.array(key >= cut_off - 1e-9))
            yield pa.RecordBatch.from_arrays(rows.columns[:-2], rows.schema.names[:-2])
        forget()

    return kept.mapInArrow(run, docs.schema)
