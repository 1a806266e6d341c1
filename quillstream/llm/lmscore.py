"""Scores of documents under a recurrent language model fitted on the corpus.

Word counts cover all training documents and stay distributed; only words above
a frequency that keeps their number under MAX_COMMON, and sums by bucket, come
to the driver.  Counts of all other words meet the documents by a join.  The
network trains on all tokens of every training document: documents are dealt by
their hashed keys into shards of about SHARD_TOKENS tokens, whose number follows
from the corpus and not from its partitions; in each round a part of the shards
trains from the same network, and their networks are averaged by the tokens
they saw.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import id_and_text, small_batches, stored

#: Common words that may come to the driver and be broadcast.
MAX_COMMON = 1 << 17
#: Tokens of a shard, and rounds in which all shards are trained on, each once.
SHARD_TOKENS, ROUNDS = 5_000_000, 4
#: Texts, and tokens of them, that are scored together.
GROUP_TEXTS, GROUP_TOKENS = 8192, 3_000_000
#: Words that one task counts before it passes counts on, and that it remembers.
MAX_COUNTED, MAX_WORDS = 400_000, 200_000
#: Pieces in which networks are averaged.
PIECES = 256


def held_out(key: int | None) -> bool:
    """Whether a document is left out of training; a null key counts as an empty one."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 7 == 2


def split_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII blanks."""
    return text.encode().lower().split()


def row_key(key: int | None, text: str) -> int:
    """A 64-bit name of a row by its key and text."""
    h = xxhash.xxh64_intdigest(text.encode(), 0 if key is None else (key * 2 + 1) & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def count_words(docs: DataFrame) -> DataFrame:
    """(id, text) to (word, bucket, n) over all training documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(map(gru.bucket_of, part), pa.int32(), size=len(part)), pa.array(map(counts.__getitem__, part), pa.int64(), size=len(part))], ["word", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_out(key):
                    counts.update(split_words(text))
            if len(counts) > MAX_COUNTED:
                yield from flush()
        yield from flush()

    counted = docs.mapInArrow(run, "word binary, bucket int, n long")
    return counted.groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n"))


class Lookup(dict):
    """Words to a row of the common words' table; others to rows beyond it, by bucket."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(words))
        self.size = len(words)

    def __missing__(self, word: bytes) -> int:
        row = self.size + gru.bucket_of(word)
        if len(self) < self.size + MAX_WORDS and len(word) < 64:
            self[word] = row
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Statistics:
    """What all tasks need of the corpus: common words with counts, sums by bucket, the totals N and V."""

    def __init__(self, common: list[tuple[bytes, int]], bucket_tokens: np.ndarray, bucket_words: np.ndarray, ends: int, total: int, distinct: int):
        common = sorted(common, key=lambda x: (-x[1], x[0]))
        symbols = common[: gru.WORDS]
        tokens, words = bucket_tokens.astype(np.int64), bucket_words.astype(np.int64)
        for w, n in symbols:  # the buckets hold what is no symbol
            tokens[gru.bucket_of(w)] -= n
            words[gru.bucket_of(w)] -= 1
        self.words = [w for w, _ in common]
        self.vocabulary = gru.Vocabulary.build(symbols, tokens, ends)
        n = np.array([n for _, n in common] + [0] * gru.BUCKETS)
        self.log_count = np.log10(n + 1.0)
        buckets = np.array([1 + gru.bucket_of(w) for w in self.words[len(symbols) :]], np.int32)
        self.symbol = np.concatenate((np.arange(1 + gru.BUCKETS, 1 + gru.BUCKETS + len(symbols)), buckets, np.arange(1, 1 + gru.BUCKETS))).astype(np.int32)
        self.log_bucket = np.concatenate(([0.0], np.log10(tokens + words + 1.0), np.zeros(len(symbols))))
        self.ends, self.total, self.distinct = ends, total, distinct
        self.lookup: Lookup | None = None

    def find(self, words: list[bytes]) -> np.ndarray:
        if self.lookup is None:
            self.lookup = Lookup(self.words)
        return self.lookup.rows(words)

    def __getstate__(self):
        return {**self.__dict__, "lookup": None}


def gather(docs: DataFrame, counts: DataFrame) -> Statistics:
    """The bounded part of the corpus statistics; counts are all words' (word, bucket, n)."""
    by_bucket = counts.groupBy("bucket").agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()
    tokens, words = np.zeros(gru.BUCKETS), np.zeros(gru.BUCKETS)
    for r in by_bucket:
        tokens[r.bucket], words[r.bucket] = r.tokens, r.words
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    levels = sorted(((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    room, least = MAX_COMMON, None
    for at, n in levels:
        if n > room:
            break
        room, least = room - n, at
    common = [(bytes(r.word), r.n) for r in counts.where(level >= least).select("word", "n").collect()] if least is not None else []
    ends = docs.where(F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(7)) != 2).count()
    return Statistics(common, tokens, words, ends, int(tokens.sum()) + ends, int(words.sum()) + (ends > 0))


ENCODED = "id long, name long, held boolean, n_tokens long, common_known long, common_log double, symbol_log double, bucket_log double, symbols binary, rare string"


def _encoded(shared) -> Callable:
    """(id, text) to ENCODED: symbols and their end as 16-bit numbers, sums over the common words, and the other words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        common, end = len(s.words), np.log10(s.ends + 1.0)
        symbols = min(gru.WORDS, common)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_words(text)
                f = s.find(words)
                own = s.log_count[f]
                q = np.append(s.symbol[f], np.int32(0))
                rare = np.flatnonzero(f >= common)
                rows.append((
                    key, row_key(key, text), held_out(key), len(q), len(f) - len(rare) + (s.ends > 0), float(own.sum()) + end, float(own[f < symbols].sum()) + end,
                    float(s.log_bucket[q].sum()), q.astype("<i2").tobytes(), b" ".join(words[i] for i in rare.tolist()).decode() if len(rare) else None,
                ))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in ENCODED.split(", ")]) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], [c.split()[0] for c in ENCODED.split(", ")])

    return run


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, shard, weight, values), sorted, to one weighted sum for each piece."""
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for piece, weight, values in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            w, v = sums.get(piece, (0.0, 0.0))
            sums[piece] = (w + weight, v + weight * np.frombuffer(values, np.float32).astype(np.float64))
    pieces = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array([sums[p][0] for p in pieces], pa.float64()), pa.array([sums[p][1].tobytes() for p in pieces], pa.binary())], ["piece", "weight", "v"])


def _trained(shared) -> Callable:
    """(shard, symbols), sorted by shard, to (piece, shard, weight, values) of each shard's network."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, start = shared.value
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for shard, members in groupby(rows, key=lambda r: r[0]):
            model = _loaded(stats, start)
            seen = model.train([np.frombuffer(s, "<i2") for _, s in members])
            pieces = [p.tobytes() for p in np.array_split(model.vector(), PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([shard] * PIECES, pa.int64()), pa.array([float(seen)] * PIECES), pa.array(pieces, pa.binary())], ["piece", "shard", "weight", "v"])

    return run


def fit(encoded: DataFrame, stats: Statistics) -> np.ndarray:
    """The network's parameters after every training document has been trained on; the same for any partitioning."""
    flat = gru.Model(stats.vocabulary).vector()
    shards = max(1, math.ceil(stats.total / SHARD_TOKENS))
    rounds = min(ROUNDS, shards)
    dealt = encoded.where("not held").select(F.pmod(F.xxhash64("name"), F.lit(shards)).alias("shard"), "symbols", "name")
    for k in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast((stats, flat))
        part = dealt.where(F.pmod("shard", F.lit(rounds)) == k).repartition(4 * math.ceil(shards / rounds), "shard").sortWithinPartitions("shard", "name", "symbols")
        nets = part.select("shard", "symbols").mapInArrow(_trained(shared), "piece int, shard long, weight double, v binary")
        rows = nets.repartition("piece").sortWithinPartitions("piece", "shard").mapInArrow(_average, "piece int, weight double, v binary").collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r.v, np.float64) / r.weight for r in sorted(rows, key=lambda r: r.piece)]).astype(np.float32)
        shared.unpersist()
    return flat


def _loaded(stats: Statistics, flat: np.ndarray) -> gru.Model:
    model = gru.Model(stats.vocabulary)
    model.load(flat)
    return model


def _scored(shared) -> Callable:
    """Rows whose last column holds symbols, to the same with the network's score in its place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(*shared.value)
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            network, at = model.score(texts), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(network[at : at + b.num_rows], pa.float64())], [*b.schema.names[:-1], "network"])
                at += b.num_rows
            held.clear()
            texts.clear()

        size = 0
        for batch in batches:
            held.append(batch)
            texts += [np.frombuffer(s, "<i2") for s in batch.column(batch.num_columns - 1).to_pylist()]
            size += sum(len(t) for t in texts[-batch.num_rows :])
            if len(texts) >= GROUP_TEXTS or size >= GROUP_TOKENS:
                yield from flush()
                size = 0
        yield from flush()

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unigram baseline and network score (log10) of every whole text.

    Returns ``id_col``, ``held_out``, ``n_tokens`` (words and the end),
    ``n_known`` (those seen in training), ``train_tokens``, ``base_score`` and
    ``score``, a row for each row.  A null text counts as empty: its only token
    is the end.  A null key counts as an empty one and is trained on; repeated
    rows stay, and count as often in training; without training documents every
    base probability is one and the network stays as it begins; an empty table
    gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = id_and_text(docs, id_col, text_col)
    counts = stored(count_words(read))
    stats = gather(read, counts)
    encoded = stored(read.mapInArrow(_encoded(spark.sparkContext.broadcast(stats)), ENCODED).withColumn("row", F.monotonically_increasing_id()))
    flat = fit(encoded, stats)
    kept = ["id", "row", "n_tokens", "common_known", "common_log", "symbol_log", "bucket_log"]
    shared = spark.sparkContext.broadcast((stats, flat))
    scored = encoded.select(*kept, "symbols").mapInArrow(_scored(shared), "id long, row long, n_tokens long, common_known long, common_log double, symbol_log double, bucket_log double, network double")
    rare = encoded.where("rare is not null").select("row", F.explode(F.split("rare", " ")).alias("word")).withColumn("word", F.col("word").cast("binary"))
    known = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_log"))
    out = scored.join(known, "row", "left")
    logs = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        (F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(7)) == 2).alias("held_out"),
        "n_tokens",
        (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(stats.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(stats.total + stats.distinct + 1))).alias("base_score"),
        (F.col("network") + logs - F.col("symbol_log") - F.col("bucket_log")).alias("score"),
    )
