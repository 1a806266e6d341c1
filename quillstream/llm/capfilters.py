"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a random product code: the space is cut into blocks, each
with its own small random code, and every combination of code words is one
direction.  A vector belongs to all directions whose inner product with it
exceeds the cap's height; because a direction's product is a sum over blocks,
these are listed by expanding block by block and dropping what can't reach the
height any more.  Filters that differ in the last code word only make one cell,
and a vector travels once to each cell that it has filters in.  Vectors that
share a filter are compared exactly, each pair in the cell of the smallest filter
that both share (Becker, Ducas, Gama and Laarhoven, "New directions in nearest
neighbor searching", 2016).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: Filters that a vector is in on average, and at least; two vectors at the threshold share most of them.
LIST_LENGTH, LEAST_LISTED = 24, 20
#: Vectors that a filter should hold on average.
FILL = 8
#: Larger cells are dealt out as pairs of chunks of this size.
CHUNK = 2048


class ProductCode:
    """Directions for vectors of one length, fixed by the seed."""

    def __init__(self, dims: int, directions: float, seed: int = 3):
        self.blocks = max(1, min(dims, 2 if directions < 1 << 18 else 3 if directions < 1 << 26 else 4))
        self.words = max(2, math.ceil(directions ** (1 / self.blocks)))
        rng = np.random.default_rng(seed + dims)
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.bounds = np.linspace(0, dims, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.bounds, self.bounds[1:]):
            code = rng.standard_normal((self.words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) * math.sqrt((b - a) / dims))
        share = min(0.5, LIST_LENGTH / self.words**self.blocks)
        self.height = NormalDist().inv_cdf(1 - share) / math.sqrt(dims)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all directions that unit vectors x exceed the height for, sorted by row.

        The code is thinner in some places; where it gives a vector fewer than
        LEAST_LISTED directions, the height is lowered for it step by step.
        """
        step, height = 0.25 / math.sqrt(x.shape[1]), np.full(len(x), self.height)
        done_row, done_name, todo = [], [], np.arange(len(x))
        least = min(LEAST_LISTED, self.words**self.blocks)
        while len(todo):
            row, name = self._exceeding(x[todo], height[todo])
            enough = np.bincount(row, minlength=len(todo)) >= least
            ok = enough[row]
            done_row.append(todo[row[ok]])
            done_name.append(name[ok])
            todo = todo[~enough]
            height[todo] -= step
        row, name = np.concatenate(done_row), np.concatenate(done_name)
        order = np.argsort(row, kind="stable")
        return row[order], name[order]

    def _exceeding(self, x: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x @ self.turn
        scores = [x[:, a:b] @ c.T for a, b, c in zip(self.bounds, self.bounds[1:], self.codes)]
        rest = np.cumsum([s.max(1) for s in scores[::-1]], axis=0)[::-1]
        rest = np.vstack((rest[1:], np.zeros((1, len(x)))))
        row, total, name = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for k, s in enumerate(scores):
            grown = total[:, None] + s[row]
            at, word = np.nonzero(grown >= (height - rest[k])[row][:, None])
            total, name, row = grown[at, word], name[at] * self.words + word, row[at]
        return row, name


def _filter_type(directions: float) -> str:
    """The packed type of filter names; a product code has few more directions than asked for."""
    return "<i4" if directions < 1 << 30 else "<i8"


def _lists(batches: Iterable[pa.RecordBatch], directions: float) -> Iterator[pa.RecordBatch]:
    """(rep, label, size, vec) to (rep, label, size, dims, vec, filters, cells).

    ``vec`` is packed, as floats where these hold the same numbers, else as
    doubles; ``filters`` is the packed sorted list of the vector's filters, and
    ``cells`` has their names without the last code word.
    """
    codes: dict[int, ProductCode] = {}
    for batch in batches:
        n, vectors = batch.num_rows, batch.column(3).to_pylist()
        packed, lists, cells = [b""] * n, [b""] * n, [[]] * n
        by_dims: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dims.setdefault(len(v), []).append(i)
        for dims, members in by_dims.items():
            code = codes.setdefault(dims, ProductCode(dims, directions))
            for at in range(0, len(members), 256):
                part = members[at : at + 256]
                x = np.array([vectors[i] for i in part], np.float64)
                with np.errstate(over="ignore"):
                    short = x.astype("<f4")
                exact = (short == x).all(1)
                row, name = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
                for k, (i, found) in enumerate(zip(part, np.split(name, np.searchsorted(row, np.arange(1, len(part)))))):
                    found = np.sort(found)
                    packed[i] = short[k].tobytes() if exact[k] else x[k].astype("<f8").tobytes()
                    lists[i] = found.astype(_filter_type(directions)).tobytes()
                    cells[i] = np.unique(found // code.words).tolist()
        dims = pa.array([len(v) for v in vectors], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], dims, pa.array(packed, pa.binary()), pa.array(lists, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["rep", "label", "size", "dims", "vec", "filters", "cells"])


def _first_shared(lists: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest filter that the vectors of each pair share, -1 if none; rows of lists are sorted and end in -1.

    All pairs' lists are merged side by side; alike vectors meet after a few steps.
    """
    out, todo = np.full(len(a), -1, np.int64), np.arange(len(a))
    i, j = np.zeros((2, len(a)), np.int64)
    while len(todo):
        x, y = lists[a, i], lists[b, j]
        met = x == y
        out[todo[met]] = x[met]
        on = ~met & (x >= 0) & (y >= 0)
        less = (x < y)[on]
        todo, a, b, i, j = todo[on], a[on], b[on], i[on] + less, j[on] + ~less
    return out


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """up (the smallest known member of each one's component) with the links a to b."""
    while True:
        p, q = up[a], up[b]
        apart = p != q
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (up[up] != up).any():
            up = up[up]


def _compare(batches: Iterable[pa.RecordBatch], threshold: float, directions: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, to link counts (rep, n, null) and edges of a forest (rep, null, to)."""
    left, words = None, {}

    def cell(dims: int, name: int, two: bool, rep, size, chunk, vectors, packed) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(rep)
        x = np.array([np.frombuffer(v, "<f4" if len(v) == 4 * dims else "<f8") for v in vectors], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        names = [np.frombuffer(v, _filter_type(directions)) for v in packed]
        lists = np.full((n, max(map(len, names)) + 1), -1, np.int64)
        for i, v in enumerate(names):
            lists[i, : len(v)] = v
        if dims not in words:
            words[dims] = ProductCode(dims, directions).words
        n_links, up = np.zeros(n), np.arange(n)
        for at in range(0, n, 256):
            a, b = np.nonzero(x[at : at + 256] @ x[at:].T >= threshold)
            ok = a < b
            a, b = a[ok] + at, b[ok] + at
            if two:
                ok = chunk[a] != chunk[b]
                a, b = a[ok], b[ok]
            first = _first_shared(lists, a, b)  # each pair once: where the smallest filter of both is
            ok = (first >= 0) & (first // words[dims] == name)
            a, b = a[ok], b[ok]
            n_links += np.bincount(a, size[b], n) + np.bincount(b, size[a], n)
            up = _joined(up, a, b)
        some, hung = np.flatnonzero(n_links), np.flatnonzero(up != np.arange(n))
        return [(rep[some], n_links[some].astype(np.int64), None), (rep[hung], None, rep[up[hung]])]

    def run(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(k).combine_chunks() for k in range(t.num_columns)]
        key = list(zip(*(cols[k].to_pylist() for k in range(5))))  # label, dims, cell, i, j
        rep, size, chunk = (cols[k].to_numpy(zero_copy_only=False) for k in (5, 6, 7))
        vectors, lists = cols[8].to_pylist(), cols[9].to_pylist()
        out, start = [], 0
        for end in range(1, len(key) + 1):
            if end == len(key) or key[end] != key[start]:
                if end - start > 1:
                    _, dims, name, i, j = key[start]
                    out += cell(dims, name, i != j, rep[start:end], size[start:end], chunk[start:end], vectors[start:end], lists[start:end])
                start = end
        parts = [[pa.nulls(len(r), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (r, m, to)] for r, m, to in out]
        cols = [pa.concat_arrays([p[k] for p in parts]) if parts else pa.array([], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays(cols, ["rep", "n", "to"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        last = [t.column(k)[-1].as_py() for k in range(5)] if t.num_rows else None
        at = t.num_rows
        while at and all(t.column(k)[at - 1].as_py() == last[k] for k in range(4, -1, -1)):
            at -= 1
        left = t.slice(at)
        if at:
            yield run(t.slice(0, at))
    if left is not None and left.num_rows:
        yield run(left)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links and components of vectors with equal labels and a cosine of at least threshold.

    Returns ``id_col``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest key reachable, itself included) and ``kept``
    (whether that is the row's own key), a row for each row.  Null labels and
    vectors, vectors of length zero, and those with null or non-finite
    components link with nothing, and so do vectors of different lengths.  Rows
    without a key link with nothing and have a null component; rows that repeat
    key, label and vector count as one vector; an empty table gives an empty
    table; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0.0)
    usable = F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = rows.where(usable).withColumn("vec", F.transform("vec", lambda v: v + 0.0))
    classes = cut(good.groupBy("label", "vec", "id").agg(F.lit(1).alias("one")).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    directions = max(256.0, LIST_LENGTH * largest / FILL)

    listed = cut(classes.select("rep", F.col("label").cast("string").alias("label"), "size", "vec").mapInArrow(
        lambda it: _lists(it, directions), "rep long, label string, size long, dims int, vec binary, filters binary, cells array<long>"
    ))
    held = listed.select("rep", "label", "dims", F.explode("cells").alias("cell"))
    counts = held.groupBy("label", "dims", "cell").agg(F.count("*").alias("n")).where("n > 1")
    # Keys alone learn how full their cells are; a vector then goes once to each cell, or to each pair of chunks of a full one.
    shared = held.join(counts, ["label", "dims", "cell"]).groupBy("rep").agg(F.collect_list(F.struct("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))).alias("shared"))
    dealt = listed.drop("cells").join(shared, "rep").select("*", F.inline("shared")).drop("shared")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j")))
    dealt = dealt.select("label", "dims", "cell", F.inline(meets), "rep", "size", "chunk", "vec", "filters")
    place = ["label", "dims", "cell", "i", "j"]
    found = cut(dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(lambda it: _compare(it, threshold, directions), "rep long, n long, to long"))

    links = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = classes.join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = good.join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
