"""A trie of conversations by partition refinement.

All distinct conversations start in one class.  Turn by turn, each active class
splits by its members' next turn, and every part is a node of the trie.  A class
of one conversation retires: its tail is a chain without branches and is never
looked at again.  Counts and sums are folded back from the ends to the root.

Large classes are refined by joins, one turn a round.  Classes of at most SMALL
conversations are refined to their end by tasks that read their turns in order
and hold one label for each conversation, whatever the number of turns.  Turns
are named by digests, so texts travel once, to be digested.  Copies of a
conversation are one member with a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Conversations of a class that a task refines by itself.
SMALL = 256
#: Conversations that lend their first turns to the others: those whose key is a multiple of this; turns lent are fewer than LENT.
STEP, LENT = 5, 9
#: Last bits of the keys in one piece of a list of ends, so that a piece holds 1,024 keys at most.
PIECE_BITS = 10


def head_turns(conv: Column) -> Column:
    """How many turns a conversation borrows: the CRC-32 of its decimal key modulo LENT."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(LENT))


def turns_of(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), name (digest of role and text) and bytes (of the text) of every turn; by turn, null first, then role and text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    named = table.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("name"), F.octet_length(text).cast("long").alias("bytes"), role.alias("role"),
    ).where("conv is not null")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "name")
    return named.withColumn("pos", F.row_number().over(order)).select("conv", "pos", "name", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, depth, name, bytes: the first turns of conversation conv - conv % STEP, then its own after as many."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    borrows = convs.where(F.col("conv") % STEP != 0).select("conv", (F.col("conv") - F.col("conv") % STEP).alias("lender"), head_turns(F.col("conv")).alias("h"))
    lent = turns.where(F.col("pos") < LENT).select(F.col("conv").alias("lender"), F.col("pos").alias("depth"), "name", "bytes")
    size = convs.select(F.col("conv").alias("lender"), F.col("n").alias("has"))
    plan = stored(borrows.join(size, "lender", "left").withColumn("got", F.least("h", F.coalesce("has", F.lit(0)))).select("conv", "lender", "h", "got"))
    heads = lent.join(plan.where("got > 0").drop("got"), "lender").where(F.col("depth") <= F.col("h")).select("conv", "depth", "name", "bytes")
    own = turns.join(plan.select("conv", "h", "got"), "conv", "left")
    tails = own.where(F.col("h").isNull() | (F.col("pos") > F.col("h"))).select("conv", (F.col("pos") - F.coalesce("h", F.lit(0)) + F.coalesce("got", F.lit(0))).alias("depth"), "name", "bytes")
    return heads.unionByName(tails).withColumn("depth", F.col("depth").cast("long"))


def _refined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, depth, conv, name) in order, to (conv, depth, node, members) of every conversation until it is alone."""
    of: int | None = None
    at = -1
    label: dict[int, int] = {}  # the class that each conversation is in by now
    alone: set[int] = set()
    level: dict[tuple[int, bytes], list[int]] = {}

    def closed() -> list[tuple[int, int, int, int]]:
        rows = []
        for members in level.values():
            node = min(members)
            rows += [(c, at, node, len(members)) for c in members]
            if len(members) == 1:
                alone.add(node)
            for c in members:
                label[c] = node
        level.clear()
        return rows

    def out(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["conv", "depth", "node", "members"])

    for batch in batches:
        rows = []
        for k, depth, conv, name in zip(*(c.to_pylist() for c in batch.columns)):
            if k != of or depth != at:
                rows += closed()
                at = depth
                if k != of:
                    of = k
                    label.clear()
                    alone.clear()
            if conv not in alone:
                level.setdefault((label.get(conv, of), name), []).append(conv)
        yield out(rows)
    yield out(closed())


def refine(members: DataFrame, turns: DataFrame, small: int = SMALL) -> DataFrame:
    """(conv) and (conv, depth, name) to (conv, depth, node, members): the class of each conversation at each depth until it is alone or ends; a class is named after its least conversation."""
    first = members.agg(F.min("conv").alias("node"), F.count("*").alias("members"))
    labels = stored(members.crossJoin(F.broadcast(first)).select("conv", F.lit(0).cast("long").alias("depth"), "node", "members"))
    found, large, depth = labels, labels.where(F.col("members") > small), 0
    rest = labels.where((F.col("members") > 1) & (F.col("members") <= small)).select("conv", F.col("node").alias("class"), "depth")
    while not large.isEmpty():
        depth += 1
        step = large.select("conv", F.col("node").alias("class")).join(turns.where(F.col("depth") == depth).select("conv", "name"), "conv")
        parts = step.groupBy("class", "name").agg(F.min("conv").alias("node"), F.count("*").alias("members"))
        labels = stored(step.join(parts, ["class", "name"]).select("conv", F.lit(depth).cast("long").alias("depth"), "node", "members"))
        found, large = found.unionByName(labels), labels.where(F.col("members") > small)
        rest = rest.unionByName(labels.where((F.col("members") > 1) & (F.col("members") <= small)).select("conv", F.col("node").alias("class"), "depth"))
    ahead = turns.select("conv", F.col("depth").alias("at"), "name").join(rest, "conv").where(F.col("at") > F.col("depth"))
    owned = ahead.select("class", "at", "conv", "name").repartition("class").sortWithinPartitions("class", "at", "conv")
    inside = owned.mapInArrow(_refined, "conv long, depth long, node long, members long")
    return found.unionByName(stored(inside))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (conv, ends) in order to the digest of each list; only the state of one digest is held."""
    of, state = None, None
    for batch in batches:
        done = []
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != of:
                if state is not None:
                    done.append((of, state.hexdigest()))
                of, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield _digest_rows(done)
    yield _digest_rows([(of, state.hexdigest())] if state is not None else [])


def _digest_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv", "ends_sha256"])


def ends_digests(copies: DataFrame) -> DataFrame:
    """(conv, copy) to (conv, ends_sha256): the digest of each one's decimal copies in order, joined by commas.

    Copies meet in pieces of 2^PIECE_BITS keys at most first, and the pieces of a list
    pass through one digest in order; a digest of one text can't be split further.
    """
    piece = F.shiftright("copy", PIECE_BITS).alias("piece")
    pieces = copies.groupBy("conv", piece).agg(F.array_join(F.transform(F.sort_array(F.collect_list("copy")), lambda x: x.cast("string")), ",").alias("ends"))
    return pieces.repartition("conv").sortWithinPartitions("conv", "piece").select("conv", "ends").mapInArrow(_hashed, "conv long, ends_sha256 string")


def prefix_trie(table: DataFrame, small: int = SMALL, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every node of the trie of the rebuilt conversations, with columns named after the contract of the query.

    Turns are taken in order, a null turn first, equal ones by role and text; a
    null role or text counts as empty; rows without a conversation are left out;
    of an empty table there is no node, not even the root; keys divide as in SQL
    (the remainder has the sign of the key); other columns are not read.
    """
    spark = table.sparkSession
    small_batches(spark)
    own = stored(turns_of(table, conv_col, turn_col, role_col, text_col))
    turns = stored(rebuilt(own))
    # copies: conversations of as many turns with the same two sums of hashed turns
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "depth", "name").cast("decimal(38,0)"))
    marks = turns.groupBy("conv").agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b"))
    every = own.select("conv").distinct().join(marks, "conv", "left").select("conv", F.coalesce("n", F.lit(0)).alias("n"), "a", "b")
    every = stored(every)
    heads = every.groupBy("n", "a", "b").agg(F.min("conv").alias("rep"), F.count("*").alias("weight"))
    heads = stored(heads)
    copies = every.join(heads.withColumnRenamed("n", "n2").withColumnRenamed("a", "a2").withColumnRenamed("b", "b2"), (F.col("n") == F.col("n2")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2")))
    ends = ends_digests(copies.select(F.col("rep").alias("conv"), F.col("conv").alias("copy")))
    members = heads.select(F.col("rep").alias("conv"), "n", "weight")
    distinct = stored(turns.join(members, "conv").select("conv", "depth", "name", "bytes", "n", "weight"))

    trunk = stored(refine(members.select("conv"), distinct.select("conv", "depth", "name"), small))
    retired = trunk.groupBy("conv").agg(F.max("depth").alias("until"), F.max_by("members", "depth").alias("last"))
    leaf = (F.col("last") == 1).cast("long")
    # tails: chains of conversations that are alone, with sums from the end
    behind = Window.partitionBy("conv").orderBy(F.col("depth").desc())
    tails = distinct.join(retired.where("last = 1").select("conv", "until"), "conv").where(F.col("depth") > F.col("until"))
    chain = stored(tails.select("conv", "depth", "n", "weight", F.sum((F.col("weight") - 1) * F.col("bytes")).over(behind).alias("saved")))
    tail_sums = chain.groupBy("conv").agg(F.max("saved").alias("tail"))

    # the trunk, folded back: what a node adds itself is put to its least conversation, whose sum from the end every node above collects
    sized = trunk.join(members, "conv").join(retired.select("conv", "until", leaf.alias("leaf")), "conv").join(tail_sums, "conv", "left")
    sized = sized.join(distinct.select("conv", "depth", "bytes"), ["conv", "depth"], "left")
    sized = stored(sized.select("conv", "depth", "node", "n", "weight", "leaf", "until", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("tail", F.lit(0)).alias("tail")))
    counts = sized.groupBy("node", "depth").agg(F.sum("weight").alias("n_convs"), F.max(F.when(F.col("conv") == F.col("node"), F.col("bytes"))).alias("bytes"))
    added = counts.select(F.col("node").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("adds"))
    rows = sized.drop("bytes").join(added, ["conv", "depth"], "left").withColumn("adds", F.coalesce("adds", F.lit(0)))
    rows = rows.withColumn("from_end", F.sum("adds").over(behind) + F.col("tail")).withColumn("parent", F.lag("node").over(Window.partitionBy("conv").orderBy("depth")))
    rows = stored(rows.select("conv", "depth", "node", "parent", "n", "until", "leaf", "from_end", "weight"))
    folded = rows.groupBy("node", "depth").agg(
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("from_end").alias("saved"),
        F.max(F.when(F.col("conv") == F.col("node"), F.struct("parent", "n", "until", "leaf"))).alias("top"), F.max(F.when(F.col("n") == F.col("depth"), F.col("conv"))).alias("ends_at"),
    )
    children = rows.where((F.col("conv") == F.col("node")) & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("below"))
    chained = (F.col("top.leaf") == 1) & (F.col("top.until") == F.col("depth")) & (F.col("top.n") > F.col("depth"))
    upper = folded.join(children, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("top.parent").alias("parent_conv_id"), "n_convs", (F.coalesce("below", F.lit(0)) + chained.cast("long")).alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), "ends_at",
    )
    lower = chain.select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), F.col("weight").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), F.col("conv")).alias("ends_at"),
    )
    nodes = upper.unionByName(lower).join(ends.withColumnRenamed("conv", "ends_at"), "ends_at", "left")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: The same in DuckDB's SQL; the CRC-32 of a key is a fold over its digits, a step for each and eight (-1) for its bits.
ORACLE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(x ORDER BY pos) AS xs FROM t GROUP BY c),
h AS (SELECT c, xs, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1),
    lambda i: [ord(substr(c::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS n FROM o),
r AS (SELECT h.c, list_concat(list_slice(CASE WHEN h.c % 5 = 0 THEN h.xs ELSE coalesce(o.xs, []) END, 1, h.n), list_slice(h.xs, h.n + 1, len(h.xs))) AS xs FROM h LEFT JOIN o ON o.c = h.c - h.c % 5),
p AS (SELECT c, len(xs) AS n, unnest(range(0, len(xs) + 1)) AS d, xs FROM r),
m AS (SELECT c, n, d, list_slice(xs, 1, d) AS path, CASE WHEN d > 0 THEN strlen(xs[d].text) ELSE 0 END AS bytes FROM p),
nodes AS (SELECT d, path, min(c) AS rep, count(*) AS k, max(bytes) AS bytes, max(n) = d AS childless,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM m GROUP BY d, path),
w AS (SELECT m.c, m.d, v.rep, v.k, v.childless, v.ends, CASE WHEN m.c = v.rep THEN (v.k - 1) * v.bytes ELSE 0 END AS adds, CASE WHEN m.c = v.rep AND v.childless THEN 1 ELSE 0 END AS leaf FROM m JOIN nodes v USING (d, path)),
f AS (SELECT *, sum(adds) OVER (PARTITION BY c ORDER BY d DESC) AS below, sum(leaf) OVER (PARTITION BY c ORDER BY d DESC) AS leaves, lag(rep) OVER (PARTITION BY c ORDER BY d) AS parent FROM w),
g AS (SELECT d, rep, max(k) AS k, sum(below) AS saved, sum(leaves) AS leaves, max(ends) AS ends, max(CASE WHEN c = rep THEN parent END) AS parent FROM f GROUP BY d, rep),
kids AS (SELECT d - 1 AS d, parent AS rep, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL)
SELECT g.rep AS conv_id, CAST(g.d AS BIGINT) AS depth, g.parent AS parent_conv_id, CAST(k AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM g LEFT JOIN kids USING (d, rep)
"""
