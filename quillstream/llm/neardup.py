"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

SimHash fingerprints of the shingles meet in the tables of covering LSH (simhash);
what they link is verified on the whole sets.  Similar sets may differ in more
bits than any covering reaches, so what is left apart is looked for by prefixes:

Two sets whose similarity is 0.8 or more share one of their first n - ceil(0.8 n)
+ 1 members in any common order (prefix filtering, Bayardo et al., 2007), so
those are the keys and no pair is missed.  The order is that of the hashes, with
the most frequent keys last.  Documents with the same shingles are one node.  In
each bucket of a key, nodes try one hub; only what these links leave in
different components is compared pair by pair, and only in small buckets.

In large buckets a node x is looked at by its difference dx = x ^ h from a core h, the
members that most of a few of their nodes have: x ^ y is dx ^ dy, and sets are
similar just if |x ^ y| <= (|x| + |y|) / 9.  If dx and dy have no common member, that is
|dx| + |dy| <= (|x| + |y|) / 9; all such pairs are also similar, so they are joined by
links to the node with the least 9 |dx| - |x|.  All other similar pairs share one of the
first members of their differences (again prefix filtering), which are the keys of the
next round.  So nodes that have only a passage or their original in common meet no more.

Candidates are sifted by small parity bitmaps, which bound the members in which sets
differ (the bitmap filter of Sandes et al., 2017), and those left are verified on the
whole sets.  Tables between the steps hold keys and never texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import blocks, cut, id_and_text, may_have, own_tables, small_batches, stored
from .components import connected_components

WIDTH = 5
#: Least similarity of near-duplicates, as a fraction.
LEAST, OF = 4, 5
#: Keys of more documents than this go last, and so many of them at most (they are broadcast).
LARGE, MAX_LARGE = 32, 100_000
#: Rounds in which the nodes of a bucket try a hub, after SimHash and before all pairs that are left are compared.
HUB_ROUNDS = 1
#: Rounds in which keys of more than LARGE nodes give way to keys of differences from a core; what is large after them is compared pair by pair.
FRAMES = 1
#: Nodes that make a core.
CORE = 31
#: Bits that stand for a set where texts would be too heavy; they rule out no pair that is similar.
MARKS = 1024
#: Members of all the sets that a verifying task remembers, and names of sets that a naming task remembers.
MAX_MEMBERS, MAX_SEEN = 1 << 21, 100_000
#: Parts in which all keys of all nodes are dealt, one after the other, so that only one part's rows are on disk as shuffle files.
PARTS = 4
#: Rows of differences, which may be long, in one Arrow batch.
FRAMED_ROWS = 128


def shingles(text: str) -> np.ndarray:
    """Distinct hashes, in order, of all runs of five lower-cased (A-Z) words; of a shorter text, of all its words."""
    return np.unique(simhash.shingle_hashes(text, WIDTH).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= LEAST * (len(a) + len(b) - shared)


def name_of(s: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def marks_of(s: np.ndarray) -> list[int]:
    """MARKS bits as 64-bit numbers, one flipped by each member: of two sets, no more bits differ than members do."""
    return np.packbits((np.bincount(s & (MARKS - 1), minlength=MARKS) & 1).astype(np.uint8)).view("<i8").tolist()


def among(s: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of s are in others (sorted)."""
    if not len(others):
        return np.zeros(len(s), bool)
    return others[np.minimum(np.searchsorted(others, s), len(others) - 1)] == s


def prefix(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The keys of a set: so many of its first members that no similar set lacks them all; those in last (sorted) come last."""
    most = len(s) - -(-LEAST * len(s) // OF) + 1 if len(s) else 0
    if most:
        s = s[np.argsort(among(s, last), kind="stable")]
    return s[:most]


def difference(s: np.ndarray, core: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Members that only one of the two sets has: the set's rare members first, then those that it lacks, then others in last (sorted)."""
    d = np.setxor1d(s, core, assume_unique=True)
    return d[np.argsort(np.where(among(d, core), 1, 2 * among(d, last)), kind="stable")]


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to the keys of every text by the plain order of the hashes."""
    own_tables("neardup")
    plain = np.empty(0, np.int64)
    for batch in batches:
        keys = [prefix(shingles(t), plain) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([plain, *keys]), pa.int64())], ["key"])


def _named(shared) -> Callable:
    """(id, text) to NAMED; in a task a node's keys come once, with its first row that has an id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("neardup")
        last = shared.value
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            hashes = [simhash.shingle_hashes(t, WIDTH) for t in batch.column(1).to_pylist()]
            sets = [np.unique(h.view(np.int64)) for h in hashes]
            names = [name_of(s) for s in sets]
            prints, keys, marks = [], [], []
            for own, node, h, s in zip(ids, names, hashes, sets):
                fresh = own is not None and node not in seen
                if fresh:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(node)
                prints.append(simhash.signed(simhash.majority(h)) if fresh else None)
                keys.append(prefix(s, last) if fresh else s[:0])
                marks.append(marks_of(s) if fresh else None)
            columns = [batch.column(0), pa.array(names, pa.int64()), pa.array(map(len, sets), pa.int64(), size=len(sets)), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "n", "fp", "keys", "marks"])

    return run


NAMED = "id long, node long, n long, fp long, keys array<long>, marks array<long>"


def _frequent(docs: DataFrame) -> np.ndarray:
    """The keys, in order, that more than LARGE texts have, the MAX_LARGE most frequent of them at most."""
    times = stored(docs.select("text").mapInArrow(_keys, "key long").groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > LARGE))
    return np.array(sorted(r.key for r in times.orderBy(F.desc("times"), "key").limit(MAX_LARGE).collect()), np.int64)


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, rep) to (node, text): the text of each node's first document; only texts that may be asked for are shuffled."""
    some = may_have(docs, F.col("id"), nodes.select(F.col("rep").alias("key")))
    return some.join(nodes.select("node", "rep"), F.col("id") == F.col("rep")).select("node", "text")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets can be similar by their marks: of sets that are, at most a ninth of all members differ."""
    side = lambda name, n, m: nodes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("marks").alias(m))
    both = pairs.join(side("a", "na", "ma"), "a").join(side("b", "nb", "mb"), "b")
    differ = reduce(add, [F.bit_count(F.get("ma", F.lit(k)).bitwiseXOR(F.get("mb", F.lit(k)))) for k in range(MARKS // 64)])
    return both.where(differ * (LEAST + OF) <= (F.col("na") + F.col("nb")) * (OF - LEAST)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that are near-duplicates: by marks first, then by the nodes' texts."""
    pairs = stored(_possible(pairs, nodes))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stored(_texts(nodes.join(asked, "node", "left_semi"), docs))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader()
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                p, q = read(a, x), read(b, y)
                if p is not None and q is not None and similar(p, q):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in range(2)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _reader() -> Callable[[int, str], np.ndarray | None]:
    """For one task: from a node and its text to its set; None for another text of the same key."""
    own_tables("neardup")
    known: dict[int, np.ndarray] = {}
    held = 0

    def read(node: int, text: str) -> np.ndarray | None:
        nonlocal held
        if node not in known:
            s = shingles(text)
            if name_of(s) != node:
                return None
            if held + len(s) > MAX_MEMBERS:
                known.clear()
                held = 0
            known[node] = s
            held += len(s)
        return known[node]

    return read


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text, hub) to (hub, node, members)."""
    read = _reader()
    for batch in batches:
        found = [(h, a, read(a, x)) for a, x, h in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        for rows in blocks([r for r in found if r[2] is not None], FRAMED_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["hub", "node", "members"])


FRAMED = "node long, hub long, n long, s long, keys array<long>"


def _framed(shared) -> Callable:
    """(node, text, hub, core) to FRAMED: the size of the node's difference from the core, and its first members.

    Of two similar sets the larger has 5/4 of the smaller one's members at most, so they differ in a quarter of either at most.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, last = _reader(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, FRAMED_ROWS):
                part = batch.slice(at, FRAMED_ROWS)
                rows = [(a, h, read(a, x), core) for a, x, h, core in zip(*(part.column(k).to_pylist() for k in range(4)))]
                rows = [r for r in rows if r[2] is not None]
                diffs = [difference(r[2], np.array(r[3], np.int64), last) for r in rows]
                whole = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [len(d) for d in diffs]]
                keys = pa.array([d[: len(r[2]) // LEAST + 1] for r, d in zip(rows, diffs)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in whole], keys], ["node", "hub", "n", "s", "keys"])

    return run


def _frames(rows: DataFrame, nodes: DataFrame, docs: DataFrame, shared) -> DataFrame:
    """FRAMED of all nodes of each hub's keys; the core, which may be any set, is what most of CORE nodes have."""
    frames = stored(rows.join(_hubs(rows).select("key", F.col("hub.node").alias("hub")), "key").select("hub", "node").distinct())
    texts = stored(_texts(nodes.join(frames.select("node").distinct(), "node", "left_semi"), docs))
    number = F.row_number().over(Window.partitionBy("hub").orderBy(F.xxhash64("node"), "node"))
    few = frames.withColumn("number", number).where(F.col("number") <= CORE).select("node", "hub")
    members = few.join(texts, "node").select("node", "text", "hub").mapInArrow(_members, "hub long, node long, members array<long>")
    times = members.select("hub", "node", F.explode("members").alias("member")).distinct().groupBy("hub", "member").agg(F.count("*").alias("times"))
    core = times.where(F.col("times") * 2 > CORE).groupBy("hub").agg(F.sort_array(F.collect_list("member")).alias("core"))
    both = frames.join(texts, "node").join(core, "hub", "left").select("node", "text", "hub", F.coalesce("core", F.array().cast("array<long>")).alias("core"))
    return stored(both.mapInArrow(_framed(shared), FRAMED))


def _around(framed: DataFrame) -> DataFrame:
    """Links (a, b) to the node nearest to its core, of all that are surely similar to it: |x ^ y| <= |dx| + |dy|."""
    far = F.col("s") * (LEAST + OF) - F.col("n") * (OF - LEAST)
    near = framed.groupBy("hub").agg(F.min_by(F.struct("node", far.alias("far")), F.struct(far, "node")).alias("o"))
    both = framed.join(near, "hub").where((F.col("node") != F.col("o.node")) & (far + F.col("o.far") <= 0))
    return both.select("node", F.col("o.node").alias("o")).select(*_ordered("node", "o")).distinct()


def _close(m: Column, n: Column) -> Column:
    return F.least(m, n) * OF >= F.greatest(m, n) * LEAST


def _reach(n: Column, s: Column, at: Column, n2: Column, s2: Column, at2: Column) -> Column:
    """Whether two sets of n and n2 members, whose differences (of s and s2) have their first common key at these places, can be similar."""
    behind = lambda s, at, s2: (s - s2 - at * 2) * (LEAST + OF) + (n + n2) * (OF - LEAST) >= 0
    return behind(s, at, s2) & behind(s2, at2, s)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows of keys that several nodes have; rows are dealt by key once, to be counted and joined."""
    dealt = rows.repartition("key").dropDuplicates(["key", "node"])
    several = dealt.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    return dealt.join(several.select("key"), "key")


def _dealt_in_parts(rows: DataFrame) -> DataFrame:
    """_dealt of all rows, stored; each part has its own keys."""
    part = F.pmod("key", F.lit(PARTS).cast("long"))
    return reduce(DataFrame.unionByName, [stored(_dealt(rows.where(part == k))) for k in range(PARTS)])


def _alike(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that make the same components as all nodes whose fingerprints are within SimHash's radius, found by its covering tables."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.select("node", "fp").join(first, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    both = same.union(simhash.near_edges(first).select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with their node's component c over the edges, of keys whose nodes aren't all in one."""
    joined = connected_components(edges).withColumnRenamed("component", "joined")
    rows = rows.join(joined, "node", "left").select("key", "node", "n", "s", "at", F.coalesce("joined", "node").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return stored(rows.join(mixed, "key", "left_semi"))


def _meeting(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different components that have a key early enough in common."""
    other = rows.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "s", "at", "c")])
    early = _reach(*[F.col(c) for c in ("n", "s", "at", "n2", "s2", "at2")])
    meets = rows.join(other, "key").where((F.col("node") < F.col("node2")) & (F.col("c") != F.col("c2")) & _close(F.col("n"), F.col("n2")) & early)
    return meets.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, hub): of each key the node in whose order it stands first, that with the fewest rare members."""
    return rows.groupBy("key").agg(F.min_by(F.struct("node", "n", "s", "c", "at"), F.struct(F.col("at") / F.col("s"), F.xxhash64("node"))).alias("hub"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_edges(named: DataFrame, nodes: DataFrame, docs: DataFrame, shared) -> DataFrame:
    """NAMED and (node, rep, n, fp, marks) with distinct node to (a, b): links that make the same components as all near-duplicate pairs."""
    rows = _dealt_in_parts(named.select("node", "n", F.posexplode("keys").alias("at", "key"))).withColumn("s", F.col("n"))
    tried = stored(_alike(nodes))
    edges = stored(_verified(tried, nodes, docs))
    rows = _apart(rows, edges)
    for _ in range(HUB_ROUNDS):
        sides = [F.col(c) for c in ("n", "s", "at", "hub.n", "hub.s", "hub.at")]
        meets = rows.join(_hubs(rows), "key").where((F.col("c") != F.col("hub.c")) & _close(F.col("n"), F.col("hub.n")) & _reach(*sides))
        # of the hubs of its keys a node tries the one that it shares most keys with
        best = meets.groupBy("node", F.col("hub.node").alias("o")).agg(F.count("*").alias("shared")).groupBy("node").agg(F.max_by("o", F.struct("shared", "o")).alias("o"))
        now = best.select(*_ordered("node", "o")).distinct()
        now = stored(now.join(tried, ["a", "b"], "left_anti"))
        edges, tried = edges.union(stored(_verified(now, nodes, docs))), tried.union(now)
        rows = _apart(rows, edges)
    rest = None
    for number in range(FRAMES + 1):
        size = rows.groupBy("key").agg(F.count("*").alias("size"))
        large = size.where(F.col("size") > LARGE).select("key")
        last = number == FRAMES or large.isEmpty()
        now = stored(_meeting(rows if last else rows.join(size.where(F.col("size") <= LARGE).select("key"), "key", "left_semi")))
        rest = now if rest is None else rest.union(now)
        if last:
            break
        rows = stored(rows.join(large, "key", "left_semi"))
        framed = _frames(rows, nodes, docs, shared)
        edges = edges.union(stored(_around(framed)))
        keys = framed.select("node", "hub", "n", "s", F.posexplode("keys").alias("at", "member"))
        rows = _apart(stored(_dealt(keys.select(F.xxhash64("hub", "member").alias("key"), "node", "n", "s", "at"))), edges)
    return edges.union(_verified(rest.distinct().join(tried, ["a", "b"], "left_anti"), nodes, docs))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``component_id`` of every document, a row for each row.

    The component is the smallest key reachable over links of at least 0.8 exact
    similarity, itself included.  Texts with the same shingles are alike, null
    and blank ones among them; a row with a null key gets the component of its
    shingles (null if no row with a key has them); an empty table gives an empty
    table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    read = id_and_text(docs, id_col, text_col)
    last = docs.sparkSession.sparkContext.broadcast(_frequent(read))
    named = stored(read.mapInArrow(_named(last), NAMED))
    columns = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "fp", "marks")]
    nodes = stored(named.groupBy("node").agg(F.min("id").alias("rep"), *columns).where("rep is not null"))
    joined = connected_components(near_edges(named, nodes, read, last))
    of = nodes.select("node", "rep").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = of.groupBy("c").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "c").select("node", "component_id")
    return named.select("id", "node").join(of, "node", "left").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first of each group; rows without a key stay, of repeated rows one stays."""
    found = cut(near_duplicates(docs, id_col, text_col))
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
    once = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").select(docs.columns)
    if not repeated.isEmpty():
        once = once.dropDuplicates([id_col])
    return once.unionByName(docs.where(F.col(id_col).isNull()))
