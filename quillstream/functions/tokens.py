"""Token, number and identifier columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import normal_letters, or_empty


def tokens(c: Column) -> Column:
    """Distinct content tokens of a text's normal form."""
    # no token holds white space, so its runs needn't become one space
    found = F.transform(F.regexp_extract_all(normal_letters(c), F.lit(P.TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, P.TOKEN_EDGES, ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= P.LEAST_TOKEN) & ~t.isin(*P.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def canonical_number(c: Column) -> Column:
    """Without trailing punctuation and thousands commas; a percent sign stays."""
    percent = F.when(c.endswith("%"), "%").otherwise("")
    core = F.regexp_replace(F.regexp_replace(c, "%$", ""), r"[.,:/-]+$", "")
    core = F.regexp_replace(core, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    return F.when(core == "", "").otherwise(F.concat(core, percent))


def _if_digits(c: Column, found: Column) -> Column:
    """What is found in a text with a digit; none in others, which most are, so that they aren't searched."""
    return F.when(or_empty(c).rlike(r"\p{Nd}"), found).otherwise(F.array().cast("array<string>"))


def numbers(c: Column) -> Column:
    """Distinct standalone numbers, canonical, links left aside."""
    found = F.regexp_extract_all(F.regexp_replace(or_empty(c), P.URL, ""), F.lit("(?U)" + P.NUMBER), F.lit(0))
    return _if_digits(c, F.array_distinct(F.filter(F.transform(found, canonical_number), lambda n: n != "")))


def identifier_numbers(c: Column) -> Column:
    """Distinct numbers inside tokens that mix letters and digits."""
    found = F.regexp_extract_all(F.regexp_replace(or_empty(c), P.URL, ""), F.lit("(?U)" + P.IDENTIFIER), F.lit(0))
    mixed = F.filter(found, lambda t: t.rlike("[A-Za-z]") & t.rlike("[0-9]"))
    inner = F.flatten(F.transform(mixed, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), canonical_number)))
    return _if_digits(c, F.array_distinct(F.filter(inner, lambda n: n != "")))


def all_numbers(c: Column) -> Column:
    return F.array_union(numbers(c), identifier_numbers(c))


def cves(c: Column) -> Column:
    """Distinct upper-case vulnerability names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(or_empty(c), F.lit(P.CVE), F.lit(0)), F.upper))


#: Behind a token's first letter: somewhere in the rest of the token is a digit or a capital.
STRICT_AHEAD = r"(?=[a-z._+/#:&()'’\\-]*+[0-9A-Z])"
#: Where a token begins behind a letter, it could have begun with that letter: looking again in the same word finds nothing.
STRICT_BEFORE = r"(?<![A-Za-z])"


def strict_tokens(entity: Column) -> Column:
    """Tokens of a name that must be kept as written: with digits, or capitals inside."""
    # only tokens with a digit or a capital behind their first letter are taken out and looked at
    found = F.regexp_extract_all(or_empty(entity), F.lit(STRICT_BEFORE + P.ENTITY_TOKEN.replace("]", "]" + STRICT_AHEAD, 1)), F.lit(0))

    def strict(t: Column) -> Column:
        letters = F.regexp_replace(t, "[^A-Za-z]", "")
        return t.rlike("[0-9]") | ((F.length(letters) >= 2) & (letters != F.upper(letters)) & letters.rlike("^.+[A-Z]"))

    return F.filter(found, strict)


def missing_entities(entities: Column, post: Column) -> Column:
    """Entities of which some strict token isn't in the post."""
    text = F.lower(F.regexp_replace(or_empty(post), r"[⁦-⁩‎‏]", ""))
    return F.filter(entities, lambda e: F.exists(strict_tokens(e), lambda t: ~F.contains(text, F.lower(t))))


def terms(c: Column) -> Column:
    """Distinct words of four letters or more that may support a link to a page."""
    common = ("this", "that", "with", "from", "have", "will", "been", "their", "they", "more", "about", "said", "into")
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(or_empty(c)), F.lit(r"[a-z][a-z0-9-]{3,}"), F.lit(0)), lambda t: ~t.isin(*common)))


def set_difference(a: Column, b: Column, most: int) -> Column:
    """Elements of a that b lacks, sorted, the first so many."""
    return F.slice(F.array_sort(F.array_except(a, b)), 1, most)
