"""Importance resampling towards a target corpus by hashed words, counted by external sorting.

Every word's bucket is written as an unsigned 16-bit number into packed streams,
one for a run of documents, with each document's offset in it; the streams are
Parquet tables in the shared folder.  Counts come from the streams alone: each
is sorted and run-length encoded, and the runs are summed by bucket.  The gains
of the buckets, a table of fixed size, are then gathered along the streams and
summed between the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Buckets (they must fit 16 bits), words in a feature, words that a drawn document has at least, percentage that is drawn, seed of the noise.
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Numbers in a stream; a longer document has a stream of its own.
STREAM = 1 << 20

#: Bytes of words (digits, letters, all beyond ASCII) in lower case, all others as blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_STREAMS = "ids array<long>, offsets array<long>, stream binary"


def buckets_of(text: bytes, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """The bucket of every run of 1 to run consecutive words, as unsigned 16-bit numbers."""
    words = text.translate(_WORD_BYTES).split()
    hashes = [np.fromiter(map(crc32, words), np.uint32, len(words))]
    for n in range(2, run + 1):
        runs = [b" ".join(r) for r in zip(*(words[k:] for k in range(n)))]
        hashes.append(np.fromiter(map(crc32, runs), np.uint32, len(runs)))
    return (np.concatenate(hashes) % buckets).astype("<u2")


def _packed(buckets: int, run: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, parts)])
            stream = np.concatenate(parts).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([stream], pa.binary())], ["ids", "offsets", "stream"])

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = buckets_of(text.as_py(), buckets, run)
                if ids and (held + len(numbers) > STREAM or len(ids) >= STREAM):
                    yield full()
                    ids, parts, held = [], [], 0
                ids.append(own)
                parts.append(numbers)
                held += len(numbers)
        if ids:
            yield full()

    return work


def streams(table: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Packed streams of all whole texts, a null one as empty: ids, offsets (one more than ids) and the stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    small_batches(table.sparkSession)
    read = table.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return read.mapInArrow(_packed(buckets, run), _STREAMS)


def run_lengths(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a stream in order, and how often each occurs: sort, then the lengths of the runs."""
    numbers = np.sort(np.frombuffer(stream, "<u2"), kind="stable")
    if not len(numbers):
        return numbers, np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return numbers[starts], np.diff(np.append(starts, len(numbers)))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams to (bucket, n); the sorted runs of a task's streams are merged as they come."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for stream in batch.column(0):
            at, n = run_lengths(stream.as_py())
            total[at] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def counts(packed: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Occurrences of every bucket in all streams; as many numbers as buckets come to the driver."""
    found = packed.select("stream").mapInArrow(_runs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    of = {r.bucket: r.n for r in found}
    return [of.get(b, 0) for b in range(buckets)]


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares in target and source) by bucket."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source, target)], np.int64)


def weights(stream: bytes, offsets: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The sum of gains of each document of a stream; of one without features, zero."""
    starts, sizes = offsets[:-1], np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(gain[np.frombuffer(stream, "<u2")], starts[some])
    return out


def _weighed(gain: np.ndarray):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offsets, stream in zip(*batch.columns):
                places = np.array(offsets.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(np.diff(places)), pa.array(weights(stream.as_py(), places, gain))], ["id", "n_features", "weight"])

    return work


def _noise(id_col: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(rows: DataFrame, best_first: list[Column]) -> DataFrame:
    """rows with rank: 1, 2, 3 in the given order over the whole table, without one task that sees it all.

    Rows are dealt by ranges and numbered inside each; the ranges' sizes, as
    many as there are partitions, give the number at which each one starts.
    """
    spark = rows.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(rows.repartitionByRange(tasks, *best_first).withColumn("__range", F.spark_partition_id()))
    sizes = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    start = F.get(F.from_json(F.lit(str(starts)), "array<bigint>"), F.col("__range"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*best_first))
    return dealt.withColumn("rank", start + inside).drop("__range")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """``id_col``, n_features, weight, score and rank (null where not drawn) of every document, a row for each row.

    The documents drawn are those with the highest scores, weight plus Gumbel
    noise of the key, among those of at least least_words words; ties go to the
    smaller key, null keys last.  A null text counts as empty; repeated rows are
    counted and drawn each for itself; an empty target has no words, and empty
    docs give an empty table; other columns are not read.
    """
    packed = stored(streams(docs, id_col, text_col, buckets, run))
    aimed = streams(target.select(F.lit(0).alias("id"), target_text), "id", target_text, buckets, run)
    gain = gains(counts(packed, buckets), counts(aimed, buckets))
    found = packed.mapInArrow(_weighed(gain), "id long, n_features long, weight long")
    if run > 1:  # a document of n words has n + (n - 1) + ... features
        least_features = sum(max(0, least_words - k) for k in range(run))
    else:
        least_features = least_words
    found = stored(found.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)))
    long_enough = F.col("n_features") >= least_features
    n_drawn = percent * found.where(long_enough).count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    drawn = ranked(found.where(long_enough), order).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank").cast("long")))
    every = drawn.unionByName(found.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


#: The same in DuckDB's SQL, which has no CRC-32: a fold over the bytes of each distinct word, a step for each byte and eight (-1) for its bits.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM docs),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
words AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(x), 2),
    lambda i: [CAST('0x' || substr(x, i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 10000 AS b FROM words),
s AS (SELECT b, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY b),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), sums),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN g USING (b) GROUP BY r),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN w USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM placed
"""
