"""Link columns."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import or_empty, strip

#: scheme, user, host, port and path of a link with an authority.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::([0-9]*))?([^?#]*)"


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(or_empty(url), _PARTS, number)


def host(url: Column) -> Column:
    """Lower-case host, empty if there is none."""
    return F.lower(F.regexp_replace(part(url, 3), r"[\[\]]", ""))


def path(url: Column) -> Column:
    return part(url, 5)


def canonical(url: Column) -> Column:
    """Scheme, authority and path in one form; query and fragment dropped; others lower-case as they are."""
    raw = strip(or_empty(url))
    authority = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    joined = F.concat(F.lower(part(raw, 1)), F.lit("://"), F.lower(authority), F.regexp_replace(path(raw), "/+$", ""))
    return F.when(authority != "", joined).otherwise(F.regexp_replace(F.lower(raw), "/+$", ""))


def is_http(url: Column) -> Column:
    return or_empty(url).rlike("^https?://")


def is_own(url: Column, own_hosts: list[str], own_path: str = "") -> Column:
    """Own hosts, the own path on the short-message sites, and messenger hosts."""
    social = host(url).isin("x.com", "www.x.com", "twitter.com", "www.twitter.com")
    own = host(url).isin(*own_hosts, *P.MESSENGER_HOSTS)
    return own | (social & F.contains(F.lower(or_empty(url)), F.lit(own_path.lower())) if own_path else F.lit(False))


def is_external(url: Column, own_hosts: list[str], own_path: str = "") -> Column:
    return is_http(url) & (host(url) != "") & ~is_own(url, own_hosts, own_path)


def leaves_messenger(url: Column) -> Column:
    """An http link to any host but the messenger's."""
    return is_http(url) & ~host(url).isin(*P.MESSENGER_SITES)


def is_primary(url: Column) -> Column:
    """https, a reviewed host, no other port, nobody's name."""
    bare = (F.regexp_extract(or_empty(url), r"^[A-Za-z]+://[^/?#]*@", 0) == "") | (part(url, 2) == "")
    return or_empty(url).rlike("^https://") & host(url).isin(*P.PRIMARY_HOSTS) & part(url, 4).isin("", "443") & bare


def is_video(url: Column) -> Column:
    """https and one of the two media hosts or a host under them."""
    near = F.lit(False)
    for h in P.VIDEO_HOSTS:
        near = near | (host(url) == h) | host(url).endswith("." + h)
    return or_empty(url).rlike("^https://") & near


def is_bad_image(url: Column) -> Column:
    return F.lower(or_empty(url)).rlike("|".join(P.BAD_IMAGE_HINTS))


def first_link(urls: Column) -> Column:
    """The first http link, empty if there is none."""
    return or_empty(F.get(F.filter(F.transform(urls, lambda u: strip(or_empty(u))), is_http), F.lit(0)))


def channel(url: Column) -> Column:
    """First part of the path on a messenger host, without @."""
    first = F.regexp_replace(F.regexp_extract(path(url), r"^/*([^/]+)", 1), "^@+", "")
    return F.when(host(url).isin(*P.MESSENGER_HOSTS), first).otherwise("")


def file_name(url: Column, mime: Column, stem: str = "image") -> Column:
    """Last part of the path (its last 120 characters), or a name by type."""
    name = strip(F.element_at(F.split(path(url), "/"), -1))
    suffix = F.when(mime == "image/png", ".png").when(mime == "image/webp", ".webp").when(mime == "image/gif", ".gif").otherwise(".jpg")
    return F.when(name.contains("."), F.right(name, F.lit(120))).otherwise(F.concat(F.lit(stem), suffix))


def link_hints(urls: Column) -> Column:
    """Distinct struct host, role_hint of the links that have a host."""

    def hint(u: Column) -> Column:
        low = F.lower(path(u))
        ends = F.lit(False)
        for s in P.DOWNLOAD_SUFFIXES:
            ends = ends | low.endswith(s)
        role = F.when(host(u).isin(*P.CODE_HOSTS), "project").when(ends, "download").otherwise("source")
        return F.struct(host(u).alias("host"), role.alias("role_hint"))

    return F.array_distinct(F.filter(F.transform(F.transform(urls, lambda u: strip(or_empty(u))), hint), lambda h: h["host"] != ""))


def bare_links(text: Column) -> Column:
    """Distinct links written in a text, without trailing punctuation."""
    found = F.regexp_extract_all(or_empty(text), F.lit("(" + P.URL + ")"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"""[.,;:!?)"\]']+$""", "")))


def background_image(style: Column) -> Column:
    """First background image of a style, null if there is none."""
    return F.when(or_empty(style).rlike(P.BACKGROUND_IMAGE), F.regexp_extract(style, P.BACKGROUND_IMAGE, 1))


def srcset(value: Column) -> Column:
    """Links of a srcset, widest first, ties by link from the end of the alphabet."""

    def candidate(entry: Column) -> Column:
        bits = F.split(strip(entry), r"\s+")
        width = F.coalesce(F.regexp_extract(or_empty(F.get(bits, F.lit(1))), r"^([0-9]+)w$", 1).try_cast("long"), F.lit(0))
        return F.struct(width.alias("w"), F.replace(F.get(bits, F.lit(0)), F.lit("&amp;"), F.lit("&")).alias("u"))

    found = F.filter(F.transform(F.split(or_empty(value), ","), candidate), lambda c: c["u"] != "")
    return F.transform(F.sort_array(found, asc=False), lambda c: c["u"])


def resolve(url: Column, base: Column) -> Column:
    """A link resolved against its page (standard joining rules, which have no built-in)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for links, bases in batches:
            yield pd.Series([urljoin(b or "", (u or "").strip().replace("&amp;", "&")) if (u or "").strip() else "" for u, b in zip(links, bases)])

    return run(url, base)
