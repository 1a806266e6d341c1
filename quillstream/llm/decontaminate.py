"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a fixed mask over consecutive words that ignores some of them, so it
still hits where an ignored word was replaced.  Seeds of all documents meet the
seeds of the benchmark by hash; around each hit, every stretch of the item of
WINDOW words that holds the seed (the whole item, if it is shorter) is compared
word by word with the document along the same diagonal.

The masks are such that any stretch in which as many words were replaced as
SIMILARITY allows still holds a seed: by item length, for items of five words or
more.  Shorter items allow no replaced word and have one mask of all their words.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks (offsets of the words that they compare) at every place of an item of eight words or more.
MASKS = ((0, 1, 3, 4, 6), (0, 2, 4, 5, 6), (0, 1, 2, 5, 7))
#: One more for items of ten words, in which two may be replaced.
TEN = (0, 1, 4, 5, 8)
#: (place, mask) in items of five to seven words, in which one may be replaced: each leaves out other words.
SHORT = {
    5: ((2, (0, 1, 2)), (0, (0, 1, 4)), (0, (0, 1, 2, 3))),
    6: ((2, (0, 1, 2, 3)), (0, (0, 1, 4, 5)), (0, (0, 1, 2, 3))),
    7: ((2, (0, 1, 2, 3, 4)), (0, (0, 1, 4, 5, 6)), (0, (0, 1, 2, 3))),
}
#: Words of a compared stretch, and the part of them that must be equal.
WINDOW, SIMILARITY = 13, 0.8
#: Beyond so many seeds the benchmark's seeds are shuffled instead of broadcast, beyond so many words no words are ruled out beforehand.
MAX_BROADCAST, MAX_WORDS = 50_000, 20_000
#: Bits of the filter that rules out documents' seeds before they are shuffled: so many for each of the benchmark's, and at most.
BITS_PER_SEED, MAX_BITS = 16, 1 << 25
#: Places before and after a seed's first word that a stretch with it can reach.
BEFORE, AFTER = WINDOW - 5, WINDOW
#: Places of a document that are worked on together: rows of places carry the words of their piece, not of the whole text.
PIECE = 1024


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def placed_masks(length: int) -> list[tuple[int | None, tuple[int, ...]]]:
    """(place, mask) for items of this many words; no place: all places where the mask fits."""
    if length < 5:
        return [(0, tuple(range(length)))]
    if length < 8:
        return list(SHORT[length])
    return [(None, m) for m in MASKS + ((TEN,) if length == 10 else ())]


def _lengths(short: list[int]) -> list[int]:
    """Lengths that need masks of their own among those of a benchmark; 11 stands for all of eight and more."""
    return sorted({n for n in short if n < 8 or n == 10} | {11})


def _seed(words: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, at + k) for k in mask])


def _around(words: Column, at: Column) -> Column:
    """The words from BEFORE places before to AFTER after a place; null where there is none."""
    return F.transform(F.sequence(F.lit(-BEFORE), F.lit(AFTER - 1)), lambda k: F.when(at + k >= 0, F.get(words, at + k)))


def _item_seeds(items: DataFrame, numbers: dict[tuple[int, ...], int]) -> DataFrame:
    """(item, iw) to (item, len, q, mask, span, hash)."""
    n, q = F.size("iw"), F.col("q")
    spots = items.select("item", "iw", F.posexplode(F.transform("iw", lambda w: F.lit(1))).alias("q", "one"))
    where: dict[tuple[int, ...], list[Column]] = {}
    lengths = {m: [(length, at) for length in (*range(1, 8), 10, 11) for at, mask in placed_masks(length) if mask == m] for m in numbers}
    for mask, uses in lengths.items():
        for length, at in uses:
            right = n == length if length < 8 or mask == TEN else n >= 8
            where.setdefault(mask, []).append(right & (q + max(mask) < n if at is None else q == at))
    seeds = [F.when(reduce(or_, where[m]), F.struct(F.lit(k).alias("mask"), F.lit(max(m) + 1).alias("span"), _seed(F.col("iw"), q, k, m).alias("hash"))) for m, k in numbers.items()]
    return spots.select("item", n.alias("len"), "q", F.explode(F.array_compact(F.array(*seeds))).alias("seed")).select("item", "len", "q", "seed.*")


def _pieces(df: DataFrame) -> DataFrame:
    """(id, w) to (id, piece, w, skip): overlapping pieces of PIECE places, each with the words that its seeds and their stretches reach; the first skip words belong to the piece before."""
    start = lambda k: k * PIECE
    piece = lambda k: F.struct(k.alias("piece"), F.slice("w", F.greatest(start(k) - BEFORE, F.lit(0)) + 1, F.least(start(k), F.lit(BEFORE)) + PIECE + AFTER).alias("w"))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("w").alias("w")))
    pieces = F.when(F.size("w").between(1, PIECE), whole).when(F.size("w") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PIECE).cast("int")), piece))
    return df.select("id", F.explode(pieces).alias("x")).select("id", "x.piece", "x.w", F.least(start(F.col("x.piece")), F.lit(BEFORE)).alias("skip"))


def _doc_seeds(pieces: DataFrame, numbers: dict[tuple[int, ...], int], known: Column | None) -> DataFrame:
    """Pieces to (id, p, mask, hash, near, own), near the words from BEFORE places before to AFTER after p and own p's place there; known: whether each word is one of the benchmark's, as all of a seed's must be."""
    places = F.sequence(F.col("skip"), F.least(F.col("skip") + PIECE, F.size("w")) - 1)
    if known is not None:
        rests = {m[1:] for m in numbers}
        rest = lambda at: reduce(or_, [reduce(and_, [F.get("known", at + k) for k in m], F.lit(True)) for m in sorted(rests)])
        pieces = pieces.withColumn("known", known)
        places = F.filter(places, lambda at: F.get("known", at) & rest(at))
    # rows of places carry a few words, neither the piece nor the whole text
    first = lambda at: F.greatest(at - BEFORE, F.lit(0))
    spot = lambda at: F.struct(at.alias("at"), F.slice("w", first(at) + 1, at + AFTER - first(at)).alias("near"))
    rows = pieces.select("id", (F.col("piece") * PIECE - F.col("skip")).alias("before"), F.explode(F.transform(places, spot)).alias("spot"))
    rows = rows.select("id", (F.col("before") + F.col("spot.at")).alias("p"), F.least("spot.at", F.lit(BEFORE)).alias("own"), F.col("spot.near").alias("near"))
    seeds = [F.when(F.col("own") + max(m) < F.size("near"), F.struct(F.lit(k).alias("mask"), _seed(F.col("near"), F.col("own"), k, m).alias("hash"))) for m, k in numbers.items()]
    return rows.select("*", F.explode(F.array_compact(F.array(*seeds))).alias("seed")).select("*", "seed.*").drop("seed")


def _bits(seeds: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with a bit array in which the bit of every seed's hash is set, and the number of its bits."""
    size = 1 << min(max(n * BITS_PER_SEED, 64).bit_length(), MAX_BITS.bit_length() - 1)
    bit = F.pmod("hash", F.lit(size).cast("long"))
    parts = seeds.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("v")).groupBy("at").agg(F.bit_or("v").alias("v"))
    every = seeds.sparkSession.range(size // 64).join(parts, F.col("id") == F.col("at"), "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("a"))
    return row.select(F.transform("a", lambda x: x["v"]).alias("bits")), size


def _few_hits(df: DataFrame, items: DataFrame, seeds: DataFrame, numbers: dict[tuple[int, ...], int]) -> DataFrame:
    """Hits of a benchmark that is small enough to be broadcast, with the words around them."""
    vocabulary = [r.w for r in items.select(F.explode("iw").alias("w")).distinct().limit(MAX_WORDS + 1).collect()]
    known = F.transform("w", lambda w: w.isin(vocabulary)) if 0 < len(vocabulary) <= MAX_WORDS else None
    around = items.select("item", "iw").join(seeds, "item").select("item", "len", "q", "mask", "span", "hash", _around(F.col("iw"), F.col("q")).alias("ia"))
    hits = _doc_seeds(_pieces(df), numbers, known).join(F.broadcast(around), ["mask", "hash"])
    return hits.withColumn("da", _around(F.col("near"), F.col("own")))


def _many_hits(df: DataFrame, items: DataFrame, seeds: DataFrame, numbers: dict[tuple[int, ...], int], n: int) -> DataFrame:
    """Hits of any benchmark: only keys of seeds that pass a bit filter are shuffled, then the pieces of texts."""
    bits, size = _bits(seeds, n)
    pieces = _pieces(df)
    passed = _doc_seeds(pieces, numbers, None).drop("near", "own").crossJoin(F.broadcast(bits))
    bit = F.pmod("hash", F.lit(size).cast("long"))
    word = F.get("bits", F.shiftright(bit, 6).cast("int"))
    passed = passed.where(word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))) != 0).select("id", "p", "mask", "hash")
    hits = passed.join(seeds, ["mask", "hash"]).select(F.col("id").alias("hit"), F.floor(F.col("p") / PIECE).cast("int").alias("part"), "p", "mask", "item", "len", "q", "span")
    with_items = hits.join(items.select("item", "iw"), "item").select("hit", "part", "item", "len", "p", "q", "mask", "span", _around(F.col("iw"), F.col("q")).alias("ia"))
    at = F.col("p") - F.col("piece") * PIECE + F.col("skip")
    return pieces.join(with_items, F.col("id").eqNullSafe(F.col("hit")) & (F.col("piece") == F.col("part"))).select("id", "item", "len", "p", "q", "mask", "span", "ia", _around(F.col("w"), at).alias("da"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold stretches of benchmark items.

    Returns ``id_col``, ``item_col``, ``matched`` (most equal words in a
    stretch), ``stretch`` (its words), ``similarity`` and ``seeds`` (distinct
    hits that were confirmed: a place in the document, one in the item, and a
    mask), a row for each document and item with a stretch of at least
    SIMILARITY.  Null and empty texts and items have no overlap; null keys are
    keys like any other; rows that repeat a key and text change nothing, in
    documents and items; rows that share a key but not the text are judged
    together; empty tables give an empty table; other columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("iw")).where(F.size("iw") > 0).distinct()
    facts = items.agg(F.sum(F.size("iw")).alias("n"), F.collect_set(F.when(F.size("iw") < 11, F.size("iw"))).alias("short")).first()
    numbers = {m: k for k, m in enumerate(dict.fromkeys(m for n in _lengths(facts["short"]) for _, m in placed_masks(n)))}
    n_seeds = (facts["n"] or 0) * len(MASKS)
    seeds = _item_seeds(items, numbers)
    df = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    hits = _few_hits(df, items, seeds, numbers) if n_seeds <= MAX_BROADCAST else _many_hits(df, items, seeds, numbers, n_seeds)
    size = F.least(F.col("len"), F.lit(WINDOW))
    same = F.zip_with("da", "ia", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    first = F.greatest(F.col("span") - size, -F.col("q"))
    last = F.least(F.lit(0), F.col("len") - size - F.col("q"))
    counts = F.transform(F.sequence(first, last), lambda t: F.aggregate(F.slice("same", t + BEFORE + 1, F.col("size")), F.lit(0), lambda a, x: a + x))
    hits = hits.withColumn("size", size).withColumn("same", same).where(last >= first)
    hits = hits.select("id", "item", "size", F.struct("p", "q", "mask").alias("hit"), F.array_max(counts).alias("matched")).where(F.col("matched") >= SIMILARITY * F.col("size"))
    best = hits.groupBy("id", "item", "hit").agg(F.max("matched").alias("matched"), F.max("size").alias("stretch"))
    best = best.groupBy("id", "item").agg(F.max("matched").alias("matched"), F.max("stretch").alias("stretch"), F.count("*").alias("seeds"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("matched").cast("long").alias("matched"), F.col("stretch").cast("long").alias("stretch"),
        (F.col("matched") / F.col("stretch")).alias("similarity"), F.col("seeds"),
    )


def remove_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that overlap an item; rows without a key are judged together under the null key."""
    found = overlaps(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__hit")).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__hit")), "left_anti").select(*docs.columns)


#: The same in DuckDB's SQL: masks by item length, place -1 where a mask goes to every place that it fits.
ORACLE = r"""
WITH dw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT DISTINCT item_id AS item, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
placed(shortest, longest, place, offs) AS (VALUES
  (8, 1000000000, -1, [0, 1, 3, 4, 6]), (8, 1000000000, -1, [0, 2, 4, 5, 6]), (8, 1000000000, -1, [0, 1, 2, 5, 7]), (10, 10, -1, [0, 1, 4, 5, 8]),
  (7, 7, 2, [0, 1, 2, 3, 4]), (7, 7, 0, [0, 1, 4, 5, 6]), (7, 7, 0, [0, 1, 2, 3]),
  (6, 6, 2, [0, 1, 2, 3]), (6, 6, 0, [0, 1, 4, 5]), (6, 6, 0, [0, 1, 2, 3]),
  (5, 5, 2, [0, 1, 2]), (5, 5, 0, [0, 1, 4]), (5, 5, 0, [0, 1, 2, 3]),
  (4, 4, 0, [0, 1, 2, 3]), (3, 3, 0, [0, 1, 2]), (2, 2, 0, [0, 1]), (1, 1, 0, [0])),
ip AS (SELECT item, w, unnest(range(1, len(w) + 1)) AS q FROM iw),
bs AS (SELECT item, w AS v, q, offs, list_max(offs) + 1 AS span, array_to_string(list_transform(offs, lambda o: w[q + o]), ' ') AS seed
  FROM ip JOIN placed ON len(w) BETWEEN shortest AND longest AND q + list_max(offs) <= len(w) AND (place = -1 OR q = place + 1)),
masks AS (SELECT DISTINCT offs FROM bs),
dp AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS p FROM dw),
ds AS (SELECT id, w, p, offs, array_to_string(list_transform(offs, lambda o: w[p + o]), ' ') AS seed FROM dp, masks WHERE p + list_max(offs) <= len(w)),
hit AS (SELECT id, item, w, v, p, q, span, least(len(v), 13) AS size, offs FROM ds JOIN bs USING (offs, seed)),
scored AS (
  SELECT id, item, size, p, q, offs, list_max(list_transform(range(greatest(span - size, 1 - q), least(0, len(v) - size - q + 1) + 1),
    lambda t: list_sum(list_transform(range(0, size), lambda k: CASE WHEN p + t + k >= 1 AND w[p + t + k] = v[q + t + k] THEN 1 ELSE 0 END)))) AS matched FROM hit)
SELECT id AS doc_id, item AS item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(size) AS BIGINT) AS stretch,
  CAST(max(matched) AS DOUBLE) / max(size) AS similarity, count(DISTINCT (p, q, offs)) AS seeds
FROM scored WHERE matched >= 0.8 * size GROUP BY id, item
"""
