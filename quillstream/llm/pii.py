"""Personal data by boosted candidate selection, with DataFrame functions only.

Four fixed formats give the base spans.  Besides, high-recall generators propose
overlapping candidates (anything around an at sign, written out at signs, long
digit chains); boosted trees score each from its format and its context, and
those that reach the threshold calibrated for their generator are added where
no base span lies, or where an address goes on beyond one.  The trees are fitted on a fixed labelled sample and become
CASE expressions, so scoring stays in the JVM.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed; what the trees add is of the last.
KINDS = ("email", "ip", "card", "phone", "other")

# The patterns below find what the plain formats find, leftmost and without overlap.  Possessive
# repeats and the looks behind only keep a long run from being tried again from each of its places.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of candidates; {0,64} and the like bound what is looked at around an at sign.
AT = r"[^\s@<>()\[\]{},;:\"|]{1,64}+@[^\s@<>()\[\]{},;:\"|]{1,255}"
SPELLED = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({][aA][tT][\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({][dD][oO][tT][\])}]|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}"
DIGITS = r"(?<![0-9])[(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+"
GENERATORS = (AT, SPELLED, DIGITS)

#: Code points before a candidate that count as its context.
CONTEXT = 24
#: Items that one inner fold walks, and code points of a block that pieces are cut from.
BLOCK, CUT = 256, 1024
#: Boosting: trees of two levels, shrinkage, and the share of right ones that a threshold must have on held-out samples.
TREES, RATE, PRECISION = 40, 0.3, 0.995

CONTACT_WORDS = "tel|telefon|telefono|phone|call|mobile|cell|fax|whatsapp|sms|contact|ring|dial|appel|llama|ruf"
MAIL_WORDS = "mail|email|e-mail|write|contact|reach|courriel|correo|schreib"
ID_WORDS = "order|invoice|isbn|issue|ticket|serial|build|version|ref|no|nr|number|id|code|sku|part|page|line|row|total"


def _locate(text: Column, pattern: str) -> Column:
    """All matches: array of struct m (the match), g (code points between it and the one before), b and a (context before and after).

    The context is taken from the parts between matches and the matches beside
    them, so that no match costs a walk through the whole text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    n = F.size(found)
    rows = F.arrays_zip(
        found.alias("m"),
        F.slice(parts, 1, n).alias("gap"),
        F.slice(F.concat(F.array(F.lit("")), found), 1, n).alias("last"),
        F.slice(parts, 2, n).alias("next"),
        F.concat(F.slice(found, 2, n), F.array(F.lit(""))).alias("then"),
    )
    return F.transform(
        rows,
        lambda x: F.struct(
            x["m"].alias("m"),
            F.length(x["gap"]).cast("long").alias("g"),
            F.right(F.concat(F.right(x["last"], F.lit(CONTEXT)), F.right(x["gap"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("b"),
            F.left(F.concat(F.left(x["next"], F.lit(1)), F.left(x["then"], F.lit(1))), F.lit(1)).alias("a"),
        ),
    )


def _fold(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """An array with a value of type out for each item; step takes the state and an item, and gives the next state and the value.

    The walk goes in blocks, so appending to the values stays cheap.
    """
    none = F.array().cast(f"array<{out}>")

    def add(acc: Column, x: Column) -> Column:
        state, value = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(value.cast(out))).alias("out"))

    def block(acc: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(items, at + 1, BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), add)
        return F.struct(inner["state"].alias("state"), F.concat(acc["outs"], F.array(inner["out"])).alias("outs"))

    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK))
    whole = F.aggregate(starts, F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("outs")), block)
    return F.when(F.size(items) > 0, F.flatten(whole["outs"])).otherwise(none)


def _places(pairs: Column) -> Column:
    """(m, g, b, a) with the gap before each match, to struct s, e, m, b, a."""

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + x["g"]
        end = start + F.length(x["m"])
        return end, F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))

    return _fold(pairs, F.lit(0).cast("long"), step, "struct<s:bigint,e:bigint,m:string,b:string,a:string>")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: (F.substring(digits, i, 1).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)))
    total = F.aggregate(places, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_ok(s: Column) -> Column:
    d = _digits(s)
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)


def _octets_ok(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).try_cast("int"), F.lit(999)) <= 255))


def _features(c: Column) -> list[Column]:
    """Small whole numbers from a candidate's generator g, match m and the text before (b) and after (a)."""
    digits = F.length(_digits(c["m"]))
    groups = F.concat_ws("-", F.transform(F.filter(F.split(c["m"], "[^0-9]+", -1), lambda p: p != ""), lambda p: F.length(p).cast("string")))
    before = F.lower(c["b"])
    flag = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    return [
        c["g"],
        F.when(digits < 7, 0).when(digits < 9, 1).when(digits == 9, 2).when(digits == 10, 3).when(digits == 11, 4).when(digits == 12, 5).when(digits <= 15, 6).when(digits <= 19, 7).otherwise(8),
        flag(groups.isin("3-3-4", "1-3-3-4", "3-4-4", "2-2-2-2-2", "3-3-3", "4-3-3", "2-4-4")),
        flag(c["m"].rlike(r"^\(?[0-9]{2,4}\)")),
        F.least(F.size(F.split(groups, "-", -1)), F.lit(7)),
        flag(c["m"].contains(".")),
        flag(c["m"].contains("/")),
        flag(before.rlike(rf"(?:^|[^a-z])(?:{CONTACT_WORDS})[a-z]{{0,4}}(?:\s(?:us|me|at|on))?[\s:.=#(]{{0,4}}$")),
        flag(before.rlike(rf"(?:^|[^a-z])(?:{MAIL_WORDS})[a-z]{{0,4}}[\s:.=(]{{0,4}}(?:(?:to|at|us|me|via|by)[\s:]{{1,2}})?$")),
        flag(before.rlike(rf"(?:^|[^a-z])(?:{ID_WORDS})[a-z]{{0,4}}[\s:.=#-]{{0,4}}$")),
        flag(before.rlike(r"[A-Za-z0-9_/.$€-]$")),
        flag(c["a"].rlike(r"^[A-Za-z0-9_%/]")),
        flag(F.lower(c["m"]).rlike(r"@[^@]*[^@.\s]\.[\p{L}]{2,12}\.?$")),
        flag(F.lower(c["m"]).rlike(r"[^a-z](?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co)$")),
        flag(c["m"].rlike(r"^[\p{L}0-9]")),
        flag(F.when(c["g"] == 2, _luhn_ok(c["m"])).otherwise(False)),
    ]


N_FEATURES = 16


def labelled_sample(seed: int = 5) -> list[tuple[str, int]]:
    """Short texts that hold one candidate each, and whether it is personal: seeded, from formats and carrier phrases."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuv", k=rng.randrange(3, 9)))
    tld = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
    phone = lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(4)}"])
    contact = lambda: rng.choice(["tel ", "Tel: ", "phone ", "call ", "Phone: ", "fax ", "mobile: ", "call us: ", "whatsapp ", "téléphone ", "Telefon "])
    mail = lambda: rng.choice(["mail ", "email: ", "e-mail ", "write to ", "contact ", "reach me at ", "mailto ", "Mail "])
    plain = lambda: rng.choice(["the ", f"{word()} ", f"{word()}, ", "of ", f"{word()} and "])
    ids = lambda: rng.choice(["order ", "invoice no. ", "ISBN ", "ticket #", "serial ", "version ", "id: ", "part number ", "page ", "total "])
    spelled = lambda: f"{word()}{rng.choice(['', '.', '_'])}{d(rng.randrange(3))}{rng.choice([' [at] ', '(at)', ' (at) ', '[at]', '{at}'])}{word()}{rng.choice([' [dot] ', '(dot)', '.', ' (dot) '])}{tld()}"
    rare = lambda: f"{rng.choice(['jörg', 'rené', 'señor', 'zoë'])}.{word()}@{word()}{rng.choice(['é', 'ü', ''])}{word()}.{tld()}"
    out: list[tuple[str, int]] = []
    for _ in range(220):
        out += [(contact() + phone() + rng.choice([".", " " + word(), ",", ""]), 1) for _ in range(2)]
        out += [(mail() + spelled() + rng.choice([".", " " + word(), ""]), 1), (plain() + spelled() + " " + word(), 1)]
        out += [(rng.choice([mail, plain])() + rare() + rng.choice([" " + word(), ""]), 1)]
        out += [(ids() + rng.choice([d(rng.randrange(7, 17)), phone(), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]) + rng.choice([".", " " + word()]), 0) for _ in range(2)]
        out += [(plain() + rng.choice([d(rng.randrange(7, 22)), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(1)}.{d(2)}.{d(4)}.{d(3)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)}-{d(2)}"]) + rng.choice([".", " " + word(), "%", word()]), 0) for _ in range(4)]
        out += [(plain() + phone() + rng.choice([" " + word(), "."]), 0)]
        out += [(plain() + rng.choice([f"@{word()}", f"{word()}@{word()}", f"{word()} @ {word()}", f"{d(2)}@{d(2)}", f"{word()}@@{word()}.com", f"git@{word()}:{word()}/{word()}", f"{word()}.{word()}@{d(1)}"]) + " " + word(), 0) for _ in range(2)]
        out += [(plain() + f"{word()} (at) {word()} {word()}", 0)]
    return out


def _candidates(places: list[Column]) -> Column:
    """All generators' candidates with the context before and after."""
    item = lambda g: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(g).alias("g"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))
    return F.concat(*[F.transform(p, item(g)) for g, p in enumerate(places)])


@dataclass(frozen=True)
class Trees:
    """(feature, bound, (feature, bound, low, high), (feature, bound, low, high)) by tree, and thresholds by generator."""

    bias: float
    trees: tuple
    thresholds: tuple[float, ...]

    def margin(self, x: tuple[int, ...]) -> float:
        leaf = lambda t: t[2] if x[t[0]] <= t[1] else t[3]
        return self.bias + sum(leaf(t[2]) if x[t[0]] <= t[1] else leaf(t[3]) for t in self.trees)

    def column(self, f: Column) -> Column:
        """The margin of a struct f of features f0, f1, ..."""
        leaf = lambda t: F.when(f[f"f{t[0]}"] <= t[1], t[2]).otherwise(t[3])
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + F.when(f[f"f{t[0]}"] <= t[1], leaf(t[2])).otherwise(leaf(t[3]))
        return total


def _boost(rows: list[tuple[tuple[int, ...], int, int]]) -> Trees:
    """Newton boosting of two-level trees on (features, label, fold); thresholds on fold 0."""
    cells: dict[tuple[int, ...], list[int]] = {}
    for x, y, fold in rows:
        if fold:
            c = cells.setdefault(x, [0, 0])
            c[0] += 1
            c[1] += y
    xs = sorted(cells)
    n, pos = [cells[x][0] for x in xs], [cells[x][1] for x in xs]
    bias = math.log((sum(pos) + 1) / (sum(n) - sum(pos) + 1))
    margin = [bias] * len(xs)
    bounds = [(f, b) for f in range(N_FEATURES) for b in sorted({x[f] for x in xs})[:-1]]

    def best(members: list[int], g: list[float], h: list[float]) -> tuple:
        total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
        top = (0.0, 0, 1 << 20, total_g / (total_h + 1), total_g / (total_h + 1))
        for f, b in bounds:
            lg = lh = 0.0
            for i in members:
                if xs[i][f] <= b:
                    lg += g[i]
                    lh += h[i]
            gain = lg * lg / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g * total_g / (total_h + 1)
            if gain > top[0] + 1e-9:
                top = (gain, f, b, lg / (lh + 1), (total_g - lg) / (total_h - lh + 1))
        return top

    trees = []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [pos[i] - n[i] * p[i] for i in range(len(xs))]
        h = [n[i] * p[i] * (1 - p[i]) for i in range(len(xs))]
        _, f, b, *_ = best(list(range(len(xs))), g, h)
        sides = [[i for i in range(len(xs)) if (xs[i][f] <= b) == low] for low in (True, False)]
        leaves = []
        for members in sides:
            _, f2, b2, low, high = best(members, g, h)
            leaves.append((f2, b2, RATE * low, RATE * high))
            for i in members:
                margin[i] += RATE * (low if xs[i][f2] <= b2 else high)
        trees.append((f, b, *leaves))
    model = Trees(bias, tuple(trees), ())
    thresholds = []
    for g_id in range(len(GENERATORS)):
        held = sorted(((model.margin(x), y) for x, y, fold in rows if not fold and x[0] == g_id), reverse=True)
        right, found = 0, math.inf
        for k, (m, y) in enumerate(held):
            right += y
            if right >= PRECISION * (k + 1) and (k + 1 == len(held) or held[k + 1][0] < m):
                found = m
        thresholds.append(max(found, 0.0))
    return Trees(bias, tuple(trees), tuple(thresholds))


def _pairs_of(text: Column, has_digit: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<m:string,g:bigint,b:string,a:string>>")
    at = F.contains(text, F.lit("@"))
    small = F.lower(text)
    spelled = F.contains(small, F.lit("at)")) | F.contains(small, F.lit("at]")) | F.contains(small, F.lit("at}"))
    when = {"p0": (EMAIL, at), "p1": (IP, has_digit), "p2": (CARD, has_digit), "p3": (PHONE, F.contains(text, F.lit("+")) & has_digit), "c0": (AT, at), "c1": (SPELLED, spelled), "c2": (DIGITS, has_digit)}
    return {k: F.when(cond, _locate(text, pattern)).otherwise(none) for k, (pattern, cond) in when.items()}


def _with_candidates(df: DataFrame) -> DataFrame:
    """Adds b0 to b3 (matches of the formats), and cand with features for each candidate; expects text."""
    df = df.withColumn("__digit", F.col("text").rlike("[0-9]"))
    df = df.withColumns(_pairs_of(F.col("text"), F.col("__digit")))
    df = df.withColumns({k: _places(F.col(k)) for k in ("p0", "p1", "p2", "p3", "c0", "c1", "c2")})
    df = df.withColumn("cand", _candidates([F.col(f"c{k}") for k in range(3)]))
    features = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), *[x.cast("int").alias(f"f{k}") for k, x in enumerate(_features(c))])
    return df.withColumn("cand", F.transform("cand", features)).drop("__digit", "c0", "c1", "c2")


#: Fitted trees by seed: the sample is fixed, so a process fits them once.
_fitted: dict[int, Trees] = {}


def train(spark: SparkSession, seed: int = 5) -> Trees:
    """Boosted trees from the labelled sample, whose features the same expressions compute; every fourth text is held out."""
    if seed in _fitted:
        return _fitted[seed]
    sample = labelled_sample(seed)
    # one literal for the whole sample: an expression for each text would take seconds to build
    listed = F.lit(json.dumps([{"k": k, "text": t, "y": y} for k, (t, y) in enumerate(sample)]))
    df = spark.range(1).select(F.inline(F.from_json(listed, "array<struct<k:int,text:string,y:int>>")))
    found = _with_candidates(df).select("k", "y", F.explode("cand").alias("c")).select("k", "y", *[F.col("c")[f"f{i}"].alias(f"f{i}") for i in range(N_FEATURES)])
    rows = sorted((tuple(r[f"f{i}"] for i in range(N_FEATURES)), r.y, r.k % 4) for r in found.collect())
    _fitted[seed] = _boost(rows)
    return _fitted[seed]


def _with_clear(df: DataFrame) -> DataFrame:
    """Adds good: the candidates of high (sorted; s, n: end as a negative number, word) that overlap no span of base, or are words that hold all they meet and more.

    One walk over all starts of base spans and both ends of all candidates, with
    the number of base spans begun before and their furthest end: an end lies
    inside a base span if that end is beyond it, and no number changes between
    the ends of a candidate that holds none.
    """
    point = "struct<at:bigint,kind:int,id:int,e:bigint>"
    at = lambda p, kind, k, e: F.struct(p.alias("at"), F.lit(kind).alias("kind"), k.alias("id"), e.alias("e")).cast(point)
    none = F.lit(0).cast("long")
    both = (F.size("high") > 0) & (F.size("base") > 0)
    # kinds at one place in order: both ends before the base spans that start there, the start again after them
    points = F.array_sort(
        F.concat(
            F.transform("base", lambda b: at(b["s"], 2, F.lit(-1), b["e"])),
            F.transform("high", lambda c, k: at(c["s"], 0, k, none)),
            F.transform("high", lambda c, k: at(-c["n"], 1, k, none)),
            F.transform("high", lambda c, k: at(c["s"], 3, k, none)),
        )
    )

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        new = x["kind"] == 2
        after = F.struct((state["n"] + new.cast("int")).alias("n"), F.when(new, F.greatest(state["end"], x["e"])).otherwise(state["end"]).alias("end"))
        return after, F.struct(x["kind"].alias("kind"), x["id"].alias("id"), x["at"].alias("at"), state["n"].alias("n"), state["end"].alias("end"))

    df = df.withColumn("__points", F.when(both, points))
    seen = _fold(F.col("__points"), F.struct(F.lit(0).alias("n"), F.lit(-1).cast("long").alias("end")), step, "struct<kind:int,id:int,at:bigint,n:int,end:bigint>")
    df = df.withColumn("__seen", F.when(both, F.array_sort(F.filter(seen, lambda x: x["kind"] != 2))))
    of = lambda k: F.slice("__seen", F.size("high") * k + 1, F.size("high"))
    facts = F.arrays_zip(F.col("high").alias("c"), of(0).alias("x"), of(1).alias("y"), of(2).alias("z"))
    clear = lambda f: (f["x"]["end"] <= f["x"]["at"]) & (f["y"]["end"] <= f["y"]["at"]) & ((f["x"]["n"] == f["y"]["n"]) | (f["c"]["word"] & (f["z"]["end"] < f["y"]["at"])))
    return df.withColumn("good", F.when(both, F.transform(F.filter(facts, clear), lambda f: f["c"])).otherwise(F.col("high"))).drop("__points", "__seen")


def find_personal(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns ``id_col``, ``base`` and ``every`` (arrays of struct s, k, e: start,
    number of the kind, end; code points, end exclusive; sorted), the latter
    with what the trees add, and the columns of docs named in ``keep``.  A row
    for each row; a null text counts as empty; a null key stays null; the
    generators see 64 characters before an at sign, 255 after it, and six parts
    of a written-out address: of longer ones that part is the candidate; repeated
    rows stay; an empty table gives an empty table; other columns are not read.
    """
    model = model or train(docs.sparkSession)
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])]
    df = _with_candidates(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *kept))
    n_digits = lambda x: F.length(_digits(x["m"]))
    rules = [lambda x: F.lit(True), lambda x: _octets_ok(x["m"]), lambda x: _luhn_ok(x["m"]), lambda x: n_digits(x).between(9, 15)]
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    base = F.array_sort(F.concat(*[F.transform(F.filter(f"p{k}", rule), span(k)) for k, rule in enumerate(rules)]))
    df = df.withColumn("base", base)
    df = df.withColumn("scored", F.transform("cand", lambda c: F.struct(model.column(c).alias("score"), c["s"].alias("s"), c["e"].alias("e"), c["f0"].alias("g"), ((c["f0"] == 0) & c["m"].rlike(r"^[\p{L}\p{N}](?s:.*)[\p{L}\p{N}]$")).alias("word"))))
    limits = F.array(*[F.lit(t if math.isfinite(t) else 1e300) for t in model.thresholds])
    df = df.withColumn("high", F.array_sort(F.transform(F.filter("scored", lambda c: c["score"] >= F.element_at(limits, c["g"] + 1)), lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("n"), c["word"].alias("word")))))
    df = _with_clear(df)
    # of candidates that overlap, the leftmost, then the longest
    first = _fold(F.col("good"), F.lit(-1).cast("long"), lambda end, c: (F.when(c["s"] >= end, -c["n"]).otherwise(end), c["s"] >= end), "boolean")
    df = df.withColumn("taken", F.filter(F.zip_with("good", first, lambda c, k: F.struct(c["s"].alias("s"), F.lit(len(KINDS) - 1).alias("k"), (-c["n"]).alias("e"), k.alias("first"))), lambda x: x["first"]))
    added = F.transform("taken", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return df.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", added)).alias("every"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base counts by kind, the digest of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:-1])],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("every")).alias("spans"),
    )


def redact(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span found replaced by its kind in brackets; texts without spans, and nulls, stay as they are.

    Spans that overlap become one, named after the first.  All other columns
    stay, but n_chars, where there is one, is counted anew for changed texts.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = find_personal(rows, model, "__id", "__text", keep=["__row"])
    text = F.col("__row")[text_col]
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    step = lambda end, x: (F.greatest(end, x["e"]), F.struct(x["s"].alias("s"), x["k"].alias("k"), (x["s"] >= end).alias("new"), F.greatest(end, x["e"]).alias("e")))
    walked = _fold(F.col("every"), F.lit(0).cast("long"), step, "struct<s:bigint,k:int,new:boolean,e:bigint>")
    found = found.withColumn("__walked", walked)
    # a span that overlaps none before it begins a merged one, which ends where the next such span's forerunner does
    lasts = F.zip_with("__walked", F.slice("__walked", 2, F.size("__walked")), lambda x, y: F.struct(x["e"].alias("e"), F.coalesce(y["new"], F.lit(True)).alias("last")))
    merged = F.zip_with(F.filter("__walked", lambda x: x["new"]), F.filter(lasts, lambda x: x["last"]), lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e"), x["k"].alias("k")))
    found = found.withColumn("__spans", F.when(F.size("every") > 0, merged))
    # pieces between spans are cut from the blocks that they touch, never from the whole text
    found = found.withColumn("__blocks", F.when(F.size("every") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    block = lambda p: F.floor(p / CUT).cast("int")
    cut = lambda a, b: F.substring(F.array_join(F.slice("__blocks", block(a) + 1, block(b) - block(a) + 1), ""), (a % CUT).cast("int") + 1, (b - a).cast("int"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda x: x["e"]))
    pieces = F.zip_with("__spans", F.slice(starts, 1, F.size("__spans")), lambda x, a: F.concat(cut(a, x["s"]), F.element_at(names, x["k"] + 1)))
    tail = cut(F.element_at(starts, -1), F.length(text).cast("long"))
    changed = F.col("__spans").isNotNull()
    put = {text_col: F.when(changed, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)}
    if "n_chars" in columns:
        put["n_chars"] = F.when(changed, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row")["n_chars"])
    out = found.withColumn("__text", put[text_col])
    return out.select(*[F.col("__text").alias(c) if c == text_col else put.get(c, F.col("__row")[c]).alias(c) for c in columns])
