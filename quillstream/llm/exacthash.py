"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normalised bytes.  A directory of
2^depth slots maps the first bits of a key to a bucket; it doubles, and an
overfull bucket splits by its next bit, until every bucket holds at most
CAPACITY keys or FINEST bits are used up.  Consecutive buckets, so a range of
keys, belong to one owner task.  An owner reads its keys in order, compares the
bytes of all texts of a key, and chains different texts whose keys collide.

Only keys go through the directory.  A text travels to its owner only where
several rows may have its key; a bit filter of bounded size rules out the rest,
and copies in one batch travel once.  The index (a row for each distinct text)
and the keys of all rows are Parquet tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import may_have, small_batches, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that a bucket holds before it splits, and the most bits that the directory uses; a bucket at that depth grows beyond CAPACITY.
CAPACITY, FINEST = 4096, 16


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def key_of(text: Column, bits: int = 64) -> Column:
    """The hash of a normalised text; fewer bits make keys collide, for tests."""
    h = F.xxhash64(text)
    return h if bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def _numbers(values: Iterable[int]) -> Column:
    """An array literal; an expression for each of thousands of members would take long to build."""
    return F.from_json(F.lit(str(list(values))), "array<int>")


@dataclass(frozen=True)
class Directory:
    """slots[first depth bits of a key] is the number of its bucket; buckets are numbered by their first key."""

    depth: int
    slots: tuple[int, ...]
    local: tuple[int, ...]
    sizes: tuple[int, ...]

    def bucket(self, key: Column) -> Column:
        at = F.shiftrightunsigned(key, 64 - self.depth).cast("int") if self.depth else F.lit(0)
        return F.get(_numbers(self.slots), at)

    def owners(self, n: int) -> list[int]:
        """The owner, below n, of each bucket: runs of buckets with about equally many keys."""
        before = np.cumsum([0, *self.sizes[:-1]], dtype=np.int64)
        return [int(b * n // max(1, sum(self.sizes))) for b in before]


def grow(counts: dict[int, int], finest: int, capacity: int) -> Directory:
    """The directory for so many keys by their first finest bits."""
    at_finest = np.zeros((1 << finest) + 1, np.int64)
    for prefix, n in counts.items():
        at_finest[prefix + 1] = n
    upto = np.cumsum(at_finest)
    size = lambda prefix, depth: int(upto[(prefix + 1) << (finest - depth)] - upto[prefix << (finest - depth)])
    depth, slots = 0, [(0, 0)]  # a slot refers to its bucket: (prefix, local depth)
    full = [b for b in slots if size(*b) > capacity and b[1] < finest]
    while full:
        split = set(full)
        if any(local == depth for _, local in split):
            slots = [b for b in slots for _ in range(2)]
            depth += 1
        slots = [(at >> (depth - b[1] - 1), b[1] + 1) if b in split else b for at, b in enumerate(slots)]
        full = [b for b in dict.fromkeys(slots) if size(*b) > capacity and b[1] < finest]
    buckets = list(dict.fromkeys(slots))
    number = {b: k for k, b in enumerate(buckets)}
    return Directory(depth, tuple(number[b] for b in slots), tuple(b[1] for b in buckets), tuple(size(*b) for b in buckets))


_MET = "owner int, bucket int, key long, text binary, keep_id long, n long"


def _met_in_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with the same text become one; (owner, bucket, key, text, id) to _MET."""
    for batch in batches:
        first: dict[tuple[int, bytes], list] = {}
        for owner, bucket, key, text, own in zip(*(c.to_pylist() for c in batch.columns)):
            row = first.setdefault((key, text), [owner, bucket, key, text, None, 0])
            row[4] = own if row[4] is None else row[4] if own is None else max(own, row[4])
            row[5] += 1
        columns = list(zip(*first.values())) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["owner", "bucket", "key", "text", "keep_id", "n"])


_ENTRY = "bucket int, key long, chain int, text binary, keep_id long, group_size long"


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's rows in the order of their keys, to one entry for each distinct text; only the chain of the key at hand is held."""
    key: int | None = None
    bucket, chain = 0, []  # entries [text, keep_id, n]

    def entries(done: list) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "key", "chain", "text", "keep_id", "group_size"])

    def closed() -> list:
        if len(chain) == 1 and chain[0][2] == 1:  # a lone key that the filter let through
            return []
        return [(bucket, key, at, text, keep, n) for at, (text, keep, n) in enumerate(chain)]

    for batch in batches:
        done = []
        _, buckets, keys, texts, keeps, ns = (c.to_pylist() for c in batch.columns)
        for b, k, text, keep, n in zip(buckets, keys, texts, keeps, ns):
            if k != key:
                done += closed()
                key, bucket, chain = k, b, []
            for entry in chain:
                if entry[0] == text:  # byte by byte
                    entry[1] = keep if entry[1] is None else entry[1] if keep is None else max(keep, entry[1])
                    entry[2] += n
                    break
            else:
                chain.append([text, keep, n])
        yield entries(done)
    yield entries(closed())


@dataclass(frozen=True)
class Index:
    """rows: id, key, digest of every document; entries: bucket, key, chain, digest, keep_id, group_size of every distinct text."""

    directory: Directory
    rows: DataFrame
    entries: DataFrame


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bits: int = 64) -> Index:
    """The index of all texts, written to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("key", key_of(F.col("text"), bits))
    rows = stored(read.select("id", "key", F.unhex(F.sha2("text", 256)).alias("digest")))
    # keys meet by a plain sum with partial sums first, so a key of a third of all rows is no hot one
    keys = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"), F.first("digest").alias("digest")))
    finest = min(FINEST, max(0, (keys.count() // max(1, capacity)).bit_length() + 3))
    prefix = F.shiftrightunsigned("key", 64 - finest) if finest else F.lit(0).cast("long")
    counts = {r.prefix: r.n for r in keys.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()}
    directory = grow(counts, finest, capacity)

    alone = keys.where("n = 1").select(directory.bucket(F.col("key")).alias("bucket"), "key", F.lit(0).alias("chain"), "digest", "keep_id", F.col("n").alias("group_size"))
    several = may_have(read, F.col("key"), keys.where("n > 1").select("key"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    owner = F.get(_numbers(directory.owners(tasks)), F.col("bucket"))
    placed = several.withColumn("bucket", directory.bucket(F.col("key"))).select(owner.alias("owner"), "bucket", "key", F.col("text").cast("binary").alias("text"), "id")
    met = placed.mapInArrow(_met_in_batch, _MET)
    owned = met.repartitionById(tasks, F.col("owner")).sortWithinPartitions("key")
    chained = owned.mapInArrow(_chained, _ENTRY).withColumn("digest", F.unhex(F.sha2("text", 256))).drop("text")
    return Index(directory, rows, stored(alone.unionByName(chained)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """``id_col``, keep_id, group_size, kept and text_sha256 of every document, a row for each row.

    Texts are equal when they are identical after lower-casing A-Z; a null text
    counts as empty.  keep_id is the largest key of the equal texts; a null key
    is below all others, and rows that repeat the kept key with its text are all
    marked kept.  An empty table gives an empty table; other columns are not read.
    """
    index = build(docs, id_col, text_col, capacity, bits)
    found = index.rows.join(index.entries.select("key", "digest", "keep_id", "group_size"), ["key", "digest"])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; of rows that repeat the kept key one stays, rows without a key stay only where no row of the group has one."""
    digest = F.sha2(normalised(F.col(text_col)), 256)
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    rows = docs.withColumn("__sha", digest)
    stay = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest")), "left_semi")
    return stay.dropDuplicates([id_col, "__sha"]).select(*docs.columns)


#: The same in DuckDB's SQL.
ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
