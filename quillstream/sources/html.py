"""Fields of HTML pages: parsed in Arrow batches, since SQL has no parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import patterns as P
from ..functions import text as X
from ..functions import tokens as K
from ..functions import urls as U

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Parts of a page that hold no prose.
DROPPED = frozenset("script style nav footer header aside form".split())

MESSAGE = (
    "array<struct<telegram_id:bigint,published_at:string,reply_to_id:bigint,raw_text:string,links:array<string>,image_urls:array<string>,"
    "video_urls:array<string>,video_thumbnail_urls:array<string>,has_video:boolean,has_document:boolean>>"
)
PAGE = "struct<title:string,links:array<string>,images:array<string>,paragraphs:array<string>>"


class _Node:
    __slots__ = ("attrs", "children", "classes", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.classes = attrs.get("class", "").split()

    def walk(self) -> Iterator[_Node]:
        """This node and all below it, in page order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def strings(self, skip: frozenset[str] = frozenset(["script", "style"])) -> list[str]:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                if c.strip():
                    out.append(c.strip())
            elif c.tag not in skip:
                stack.extend(reversed(c.children))
        return out

    def having(self, *classes: str) -> list[_Node]:
        return [n for n in self.walk() if any(c in n.classes for c in classes)]


class _Tree(HTMLParser):
    """A forgiving tree: an end tag closes the nearest open element of its name, or nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag == "p" and self.open[-1].tag == "p" or tag == "li" and self.open[-1].tag == "li":
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(page: str | None) -> _Node:
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    return parser.root


def _once(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def _http(values: list[str]) -> list[str]:
    return [v for v in values if v.startswith(("http://", "https://"))]


def _background(node: _Node) -> str:
    found = re.search(P.BACKGROUND_IMAGE, node.attrs.get("style", ""))
    return found[1] if found else ""


def _messages(page: str | None, css: str) -> list[dict]:
    """Messages of a channel page; nodes whose id can't be read are left aside."""
    out = []
    for node in tree(page).walk():
        post = node.attrs.get("data-post")
        if post is None or css not in node.classes:
            continue
        number = post.rsplit("/", 1)
        if len(number) < 2 or not re.fullmatch(r"[+-]?\d+", number[1].strip()):
            continue
        text = next(iter(node.having(f"{css}_text")), None)
        times = [n.attrs.get("datetime", "").strip() for n in node.walk() if n.tag == "time"]
        reply = next((n.attrs["href"] for n in node.having(f"{css}_reply") if "href" in n.attrs), "")
        answered = re.search(r"/(\d+)(?:\?.*)?$", reply)
        photos = [u for w in node.having(f"{css}_photo_wrap", f"{css}_service_photo") for u in [_background(w), *_http([n.attrs.get("src", "").strip() for n in w.walk() if n.tag == "img"])]]
        players = node.having(f"{css}_video_player", f"{css}_video_wrap")
        videos = _http([n.attrs.get("src", "").strip().replace("&amp;", "&") for w in players for n in w.walk() if n.tag == "video"])
        thumbs = [u for w in players for u in [*[_background(n) for n in w.having(f"{css}_video_thumb")[:1]], *_http([n.attrs.get("src", "").strip() for n in w.walk() if n.tag == "img"])]]
        raw = "\n".join(text.strings()) if text else ""
        bare = [u.rstrip(".,;:!?)\"]'") for u in re.findall(P.URL, raw)]
        out.append(
            {
                "telegram_id": int(number[1]), "published_at": times[0] if times and times[0] else None, "reply_to_id": int(answered[1]) if answered else None, "raw_text": raw,
                "links": _once(_http([n.attrs.get("href", "").strip() for n in node.walk() if n.tag == "a"]) + bare),
                "image_urls": _once(photos), "video_urls": _once(videos), "video_thumbnail_urls": _once(thumbs),
                "has_video": bool(players), "has_document": bool(node.having(f"{css}_document")),
            }
        )
    return out


def _page(page: str | None) -> dict:
    """Title, links, pictures, and the paragraphs and list items of the article or main part."""
    root = tree(page)
    nodes = list(root.walk())
    title = next((" ".join(n.strings(frozenset())) for n in nodes if n.tag == "title"), "")
    body = next((n for n in nodes if n.tag == "article"), None) or next((n for n in nodes if n.tag == "main"), None)
    prose: list[str] = []
    if body:
        stack = [body]
        while stack:
            n = stack.pop()
            if n.tag in DROPPED:
                continue
            if n.tag in ("p", "li"):
                prose.append(" ".join(" ".join(n.strings(DROPPED)).split()))
            stack.extend(c for c in reversed(n.children) if isinstance(c, _Node))
    meta = [n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get("property", n.attrs.get("name", "")) in ("og:image", "og:image:secure_url", "twitter:image", "twitter:image:src")]
    pictures = [n.attrs.get(k, "") for n in nodes if n.tag == "img" for k in ("data-src", "data-lazy-src", "src")]
    return {"title": title, "links": _once([n.attrs.get("href", "") for n in nodes if n.tag == "a"]), "images": _once(meta + pictures), "paragraphs": prose}


def page_fields(html: Column) -> Column:
    """struct title, links, images, paragraphs."""

    @F.pandas_udf(PAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([_page(x) for x in s], columns=["title", "links", "images", "paragraphs"])

    return run(html)


def read_messages(pages: DataFrame, html_col: str = "html", css: str = "tgme_widget_message", own_hosts: list[str] | None = None, own_names: list[str] | None = None, post_base: str = "", now: Column | None = None, order: Column | None = None) -> DataFrame:
    """Messages of channel pages as rows of the inbox; of a message on several pages the last counts.

    ``order`` tells which page is last; without it, it is the place in the table,
    which depends on how its files are split.

    ``own_hosts`` and ``own_names`` are the collected channel's own, which its
    texts lose; ``post_base`` precedes a message's number in its address.
    """

    @F.pandas_udf(MESSAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: _messages(x, css))

    hosts = own_hosts or []
    found = pages.select((F.monotonically_increasing_id() if order is None else order).alias("page"), run(html_col).alias("m")).select("page", F.inline("m"))
    latest = found.groupBy("telegram_id").agg(F.max_by(F.struct(*found.columns[2:]), "page").alias("m")).select("telegram_id", "m.*")
    first = lambda c: F.get(c, F.lit(0))
    has_images = F.size("image_urls") > 0
    return latest.select(
        "telegram_id", "published_at", "reply_to_id", F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("collected_at"), "raw_text",
        X.clean_post(F.col("raw_text"), lambda u: U.is_own(u, hosts), own_names or []).alias("clean_text"), F.col("links").alias("all_links"),
        F.filter("links", lambda u: U.is_external(u, hosts)).alias("source_links"), has_images.alias("has_image"), first("image_urls").alias("image_url"), "image_urls",
        "has_video", first("video_urls").alias("video_url"), "video_urls", "video_thumbnail_urls", "has_document",
        M.media_kind(has_images, F.col("has_video"), F.col("has_document")).alias("media_type"), F.concat(F.lit(post_base), F.col("telegram_id").cast("string")).alias("telegram_post_url"), F.lit("collected").alias("status"),
    )


def latest_id(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row: the largest message number in the pages, by pattern only."""
    ids = F.explode(F.regexp_extract_all(html_col, F.lit(r'data-post="[^"/]*/(\d+)"'), F.lit(1)))
    return pages.select(ids.alias("id")).agg(F.max(F.col("id").cast("long")).alias("latest"))


def since(messages: DataFrame, last_seen: int) -> DataFrame:
    """Messages not seen before, ascending."""
    return messages.where(F.col("telegram_id") > last_seen).orderBy("telegram_id")


def enrich(items: DataFrame, pages: DataFrame, now: Column, id_col: str = "telegram_id") -> DataFrame:
    """Adds ``primary_evidence``: excerpts of the first two reviewed links whose page is in ``pages`` (url, html).

    A paragraph counts if it has 60 characters and shares two words with the
    item; excerpts are cut at 5,000 characters, as the evidence is a quotation.
    """
    reviewed = F.slice(F.filter(F.coalesce("source_links", F.array().cast("array<string>")), U.is_primary), 1, 2)
    wanted = items.select(id_col, K.terms(F.col("text")).alias("terms"), F.posexplode(reviewed).alias("place", "url"))
    small = pages.where(F.octet_length("html") <= 500_000).join(wanted.select("url").distinct(), "url", "left_semi")
    parsed = small.withColumn("f", page_fields(F.col("html"))).select("url", F.col("f.title").alias("title"), F.col("f.paragraphs").alias("paragraphs"))
    joined = wanted.join(parsed, "url")
    useful = F.filter("paragraphs", lambda p: (F.length(p) >= 60) & (F.size(F.array_intersect(F.col("terms"), K.terms(p))) >= 2))
    excerpt = F.left(F.array_join(useful, "\n"), F.lit(5000))
    found = joined.withColumn("excerpt", excerpt).where("excerpt <> ''")
    row = F.struct(F.col("url"), F.left("title", F.lit(250)).alias("title"), F.col("excerpt").alias("text"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("retrieved_at"), F.lit("linked_primary_excerpt").alias("kind"))
    evidence = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", row.alias("row")))).alias("e")).select(id_col, F.transform("e", lambda x: x["row"]).alias("__evidence"))
    out = items.drop("primary_evidence").join(evidence, id_col, "left")
    return out.withColumn("primary_evidence", F.coalesce("__evidence", F.array().cast(evidence.schema["__evidence"].dataType))).drop("__evidence")


def image_candidates(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int = 30) -> DataFrame:
    """(url, position, image): pictures of a page, resolved, without decoration, the first so many each."""
    listed = pages.select(F.col(url_col).alias("url"), F.posexplode(page_fields(F.col(html_col))["images"]).alias("at", "raw"))
    links = listed.withColumn("image", U.resolve(F.col("raw"), F.col("url"))).where(U.is_http(F.col("image")) & ~U.is_bad_image(F.col("image")))
    each = links.groupBy("url", "image").agg(F.min("at").alias("at"))
    ranked = each.groupBy("url").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "image"))), 1, most).alias("c"))
    return ranked.select("url", F.posexplode("c").alias("position", "c")).select("url", "position", "c.image")


def select_images(images: DataFrame, post_col: str = "telegram_id", most: int = 10) -> DataFrame:
    """Per post its usable channel pictures by score (the best so many), else its one best page picture.

    Expects width, height, size and origin (channel or page); the metadata of
    fetched pictures comes from outside.
    """
    channel = F.col("origin") == "channel"
    usable = images.withColumn("score", M.image_score(F.col("width"), F.col("height"), F.col("size"), channel)).where(M.image_usable(F.col("width"), F.col("height"), F.col("size"), channel))
    item = F.struct((-F.col("score")).alias("k"), "url", "origin", "score")
    picked = usable.groupBy(post_col).agg(
        F.slice(F.array_sort(F.array_agg(F.when(channel, item))), 1, most).alias("own"), F.min_by(item, F.when(~channel, F.struct(-F.col("score"), F.col("url")))).alias("other")
    )
    chosen = F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("other"))
    return picked.select(post_col, F.posexplode(chosen).alias("rank", "i")).select(post_col, "rank", "i.url", "i.origin", "i.score")
