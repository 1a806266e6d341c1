"""Pictures that a page or a channel message offers, ranked by where they come from.

One parse in an Arrow batch gives all origins in rank order; cleaning, distinct
links and limits are expressions on the row, so nothing is shuffled until
fetched pictures are joined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import urls as U
from .html import _background, _Node, tree

#: Origins in rank order (fixed values): tag, attributes that name it, attribute with the link.
HEAD = (
    ("meta", {"property": "og:image:secure_url"}, "content"),
    ("meta", {"property": "og:image"}, "content"),
    ("meta", {"name": "twitter:image"}, "content"),
    ("meta", {"name": "twitter:image:src"}, "content"),
    ("link", {"rel": "image_src"}, "href"),
)
#: Keys of structured data whose values are pictures (fixed values).
PICTURE_KEYS = frozenset(["image", "thumbnailUrl", "contentUrl"])
#: Surroundings of body pictures in rank order (fixed values): a tag or a class.
AROUND = ("article", "main", ".article", ".post", ".entry-content", ".content", "figure")
#: Candidates of a page, pictures that are fetched of them, and pictures of a post (fixed values).
MOST, FETCHED, CHOSEN = 30, 20, 10

CANDIDATES = "array<struct<origin:string,raw:string,url:string>>"
SELECTED = "array<struct<origin:string,width:bigint,height:bigint,url:string>>"


def structured_pictures(value: object) -> list[str]:
    """The links under picture keys at any depth, in page order; a list under such a key gives its strings and is searched in its objects only."""
    found, stack = [], [(value, False)]
    while stack:
        node, named = stack.pop()
        if isinstance(node, str):
            if named:
                found.append(node)
        elif isinstance(node, dict):
            stack.extend((child, key in PICTURE_KEYS) for key, child in reversed(node.items()))
        elif isinstance(node, list):
            stack.extend((child, named) for child in reversed(node) if not named or isinstance(child, (str, dict)))
    return found


def _link(raw: str, base: str) -> str:
    raw = raw.strip().replace("&amp;", "&")
    try:
        return urljoin(base, raw) if raw else ""
    except ValueError:  # no valid link
        return ""


def _by_width(srcset: str, base: str) -> list[str]:
    sized = []
    for part in srcset.split(","):
        bits = part.split()
        if bits:
            number = bits[1][:-1] if len(bits) > 1 and bits[1].endswith("w") else ""
            sized.append((int(number) if number.isdecimal() else 0, _link(bits[0], base), bits[0]))
    return [raw for _, _, raw in sorted(sized, reverse=True)]


def _offered(page: str | None, base: str) -> list[tuple[str, str, str]]:
    """(origin, raw, link) of a page in rank order, links that repeat included."""
    head: list[list[str]] = [[] for _ in HEAD]
    data: list[str] = []
    body: list[list[str]] = [[] for _ in AROUND]
    stack: list[tuple[_Node, frozenset[int]]] = [(tree(page), frozenset())]
    while stack:
        node, inside = stack.pop()
        for k, (tag, named, attr) in enumerate(HEAD):
            if node.tag == tag and all(v in (node.attrs.get(a, "").split() if a == "rel" else [node.attrs.get(a)]) for a, v in named.items()):
                head[k].append(node.attrs.get(attr, ""))
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                data += structured_pictures(json.loads("".join(c for c in node.children if isinstance(c, str))))
            except (ValueError, RecursionError):
                pass
        if node.tag == "img":
            own = [*_by_width(node.attrs.get("srcset", ""), base), *[node.attrs.get(a, "") for a in ("data-src", "data-lazy-src", "src")]]
            for k in inside:
                body[k] += own
        within = inside | {k for k, a in enumerate(AROUND) if (a[1:] in node.classes if a[0] == "." else a == node.tag)}
        stack.extend((c, within) for c in reversed(node.children) if isinstance(c, _Node))
    listed = [("head", head), ("structured", [data]), ("body", body)]
    return [(origin, raw, _link(raw, base)) for origin, groups in listed for group in groups for raw in group]


def offered(url: Column, html: Column) -> Column:
    """array of struct origin (head, structured, body), raw, url: all pictures of a page in rank order; JSON that doesn't parse, or nests beyond the reader's depth, gives none."""

    @F.pandas_udf(CANDIDATES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, pages in batches:
            yield pd.Series([[{"origin": o, "raw": r, "url": u} for o, r, u in _offered(p, b or "")] for b, p in zip(bases, pages)])

    return run(url, html)


def candidates(found: Column, most: int = MOST) -> Column:
    """Of offered pictures the first so many that are http links and no decoration, each link once, at its best rank; expects a column, as a lambda can't hold the parse itself."""
    usable = F.filter(found, lambda x: U.is_http(x["url"]) & ~U.is_bad_image(x["url"]))
    links = F.slice(F.array_distinct(F.transform(usable, lambda x: x["url"])), 1, most)
    return F.transform(links, lambda u: F.get(F.filter(usable, lambda x: x["url"] == u), F.lit(0)))


def message_pictures(url: Column, html: Column, css: str = "tgme_widget_message") -> Column:
    """array of links: backgrounds and pictures of a channel message's photos, resolved, each once, in page order."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, pages in batches:
            out = []
            for base, page in zip(bases, pages):
                links: list[str] = []
                for node in tree(page).having(f"{css}_photo_wrap", f"{css}_service_photo"):
                    links.append(_link(_background(node), base or ""))
                    links += [u for n in node.walk() if n.tag == "img" and (u := _link(n.attrs.get("src", ""), base or "")).startswith(("http://", "https://"))]
                out.append([u for u in dict.fromkeys(links) if u])
            yield pd.Series(out)

    return run(url, html)


def resolve_pictures(posts: DataFrame, pages: DataFrame, fetched: DataFrame, id_col: str = "telegram_id", most: int = CHOSEN) -> DataFrame:
    """Per post the pictures to send, and how they were found.

    ``posts`` has image_urls and source_url; ``pages`` url and html; ``fetched``
    url, width, height and size of pictures that could be read.  The channel's
    own usable pictures come by score, the first so many; only a post without
    any gets the one best of its source page.  Adds channel_candidates,
    source_fallback_used, source_candidates and selected (origin, width,
    height, url); equal scores keep the order of the candidates.
    """
    own = F.coalesce("image_urls", F.array().cast("array<string>"))
    wanted = posts.select(id_col, "source_url", F.posexplode(F.slice(own, 1, 2 * most)).alias("at", "url")).withColumn("origin", F.lit("channel"))
    usable = lambda df, channel: df.join(fetched.select("url", "width", "height", "size"), "url").where(M.image_usable(F.col("width"), F.col("height"), F.col("size"), F.lit(channel)))
    scored = lambda df, channel: df.withColumn("score", M.image_score(F.col("width"), F.col("height"), F.col("size"), F.lit(channel)))
    item = F.struct((-F.col("score")).alias("k"), "at", F.struct("origin", "width", "height", "url").alias("picture"))
    first = scored(usable(wanted, True), True).groupBy(id_col).agg(F.transform(F.slice(F.array_sort(F.collect_list(item)), 1, most), lambda x: x["picture"]).alias("channel"))
    rest = posts.select(id_col, "source_url").join(first.select(id_col), id_col, "left_anti").where(F.coalesce("source_url", F.lit("")) != "")
    sources = pages.join(rest.select(F.col("source_url").alias("url")).distinct(), "url", "left_semi").select("url", offered(F.col("url"), F.col("html")).alias("found"))
    listed = rest.join(sources.select(F.col("url").alias("source_url"), candidates(F.col("found")).alias("list")), "source_url", "left").select(id_col, F.coalesce("list", F.array().cast(CANDIDATES)).alias("list"))
    tried = listed.select(id_col, F.posexplode(F.slice("list", 1, FETCHED)).alias("at", "x")).select(id_col, "at", F.col("x.url").alias("url"), F.lit("source").alias("origin"))
    best = scored(usable(tried, False), False).groupBy(id_col).agg(F.array(F.min(item)["picture"]).alias("page"))
    out = posts.join(first, id_col, "left").join(listed.select(id_col, F.size("list").alias("n")), id_col, "left").join(best, id_col, "left")
    none = F.array().cast(SELECTED)
    return out.withColumns(
        {
            "channel_candidates": F.size(own).cast("long"), "source_fallback_used": F.col("n").isNotNull(), "source_candidates": F.coalesce("n", F.lit(0)).cast("long"),
            "selected": F.coalesce(F.col("channel").cast(SELECTED), F.col("page").cast(SELECTED), none),
        }
    ).drop("channel", "page", "n")
