"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions gets a nonzero vector of GF(2)^4; table v (one of
the 15 nonzero vectors) compares the bits whose vector has an odd product with
v.  Up to three differing bits have vectors that span less than the whole
space, so some v is orthogonal to all of them and its table ignores every bit
that differs: no pair within the radius is missed (Pagh, "CoveringLSH", 2016).
Buckets that are still large are covered again over the bits that their table
ignored, which halves the free bits each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, small_batches
from .components import connected_components

RADIUS, TABLES, SEED = 3, 15, 42
#: Buckets with more fingerprints than this are covered again.
LARGE = 256
#: Shingles that are counted at a time.
SHINGLE_BLOCK = 32_768


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 of all runs of so many lower-cased (A-Z) words, repeats included; of a shorter text, of all its words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), "<u8", max(1, len(words) - width + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLE_BLOCK):
        bits = np.unpackbits(hashes[at : at + SHINGLE_BLOCK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64; 0 if there is no word."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a row for each row; a null or blank text has fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def _masks(bits: list[int]) -> list[tuple[int, list[int]]]:
    """For each table over these bit positions: the mask it compares and the bits it ignores."""
    vector = {b: k % TABLES + 1 for k, b in enumerate(bits)}
    odd = lambda b, v: (vector[b] & v).bit_count() & 1
    return [(sum(1 << b for b in bits if odd(b, v)), [b for b in bits if not odd(b, v)]) for v in range(1, TABLES + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels() -> list[list[int]]:
    """For each level, the masks of its tables, all bits compared so far included.

    A bucket of table t at one level is covered by tables 15 t to 15 t + 14 of
    the next.
    """
    levels, free = [], [(0, list(range(64)))]
    for _ in range(3):
        free = [(kept | mask, ignored) for kept, bits in free for mask, ignored in _masks(bits)]
        levels.append([kept for kept, _ in free])
    return levels


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (t, key), to edges that join what is within the radius in each bucket."""
    left: tuple[np.ndarray, ...] | None = None

    def edges(t: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        n, far, a, b = len(t), 0, [], []
        while True:  # the neighbour at each distance, as long as some bucket is that large
            far += 1
            same = np.flatnonzero((t[far:] == t[: n - far]) & (key[far:] == key[: n - far])) if far < n else np.empty(0, int)
            if not len(same):
                break
            near = same[np.bitwise_count(fp[same] ^ fp[same + far]) <= RADIUS]
            a.append(near)
            b.append(near + far)
        keep = _forest(np.concatenate(a), np.concatenate(b)) if a else np.empty((0, 2), int)
        return pa.RecordBatch.from_arrays([pa.array(rep[keep[:, 0]]), pa.array(rep[keep[:, 1]])], ["a", "b"])

    for batch in batches:
        now = tuple(batch.column(k).to_numpy() for k in range(4))
        now = (now[0], now[1], now[2].view(np.uint64), now[3])
        if left is not None:
            now = tuple(np.concatenate(x) for x in zip(left, now))
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut_at = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
        left = tuple(x[cut_at:] for x in now)
        if cut_at:
            yield edges(*(x[:cut_at] for x in now))
    if left is not None and len(left[0]):
        yield edges(*left)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs, those that join what no earlier pair has joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            keep.append((x, y))
    return np.array(keep, int).reshape(-1, 2)


def near_edges(reps: DataFrame) -> DataFrame:
    """(rep, fp) with distinct fp to (a, b): reps whose links make the same components as all links within the radius."""
    levels, rows, found = _levels(), None, None
    for level, masks in enumerate(levels):
        if level == 0:
            tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
            rows = reps.select("rep", "fp", F.inline(tables))
        else:
            # a table's fifteen successors, by its number
            deeper = F.transform(
                F.element_at(F.array(*[F.array(*[F.lit(signed(m)) for m in masks[15 * k : 15 * k + 15]]) for k in range(len(levels[level - 1]))]), F.col("t") + 1),
                lambda m, i: F.struct((F.col("t") * 15 + i).cast("int").alias("t"), F.col("fp").bitwiseAND(m).alias("key")),
            )
            rows = rows.select("rep", "fp", F.inline(deeper))
        size = rows.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
        rows = cut(rows.join(size, ["t", "key"]))
        last = level == len(levels) - 1  # at most 2^6 fingerprints differ in the bits left
        small = (rows if last else rows.where(F.col("size") <= LARGE)).select("t", "key", "fp", "rep")
        edges = small.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_link, "a long, b long")
        found = edges if found is None else found.union(edges)
        rows = rows.where(F.col("size") > LARGE).select("rep", "fp", "t")
        if last or rows.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Returns ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``
    (smallest key reachable over links of at most three differing bits, itself
    included), a row for each row.  Null and blank texts have fingerprint 0 and
    link like any other; repeated rows stay; a row with a null key gets the
    component of its fingerprint (null if no row with a key has it); an empty
    table gives an empty table; other columns are not read.
    """
    prints = cut(fingerprints(docs, width, id_col, text_col))
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    joined = connected_components(near_edges(reps.where("rep is not null")))
    named = reps.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first of each group; rows without a key stay, of repeated rows one stays."""
    found = near_duplicates(docs, width, id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    with_key = docs.where(F.col(id_col).isNotNull())
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
    once = with_key.join(kept, id_col, "left_semi").select(docs.columns)
    if not repeated.isEmpty():
        once = once.dropDuplicates([id_col])
    return once.unionByName(docs.where(F.col(id_col).isNull()))
