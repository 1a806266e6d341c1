"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass looks at each
block alone: link density, length and stop-word density make it good, bad or
undecided.  Markup is a feature beside them: places that never hold main text
(menus, forms, hidden parts, names that tell) are bad whatever they say, and an
article element counts where the text rules find good blocks in it, or none
elsewhere.  In the second pass an undecided block takes the label of its nearest
decided neighbours, first of those in the same article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its
    more no not of on one only or other our out over said she so some than that the their them then there these they this to up was we were
    what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me mon ne nous on ou par pas plus pour qu que qui
    sa se ses son sur un une vous
    als am auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer er es hat ich ihr im ist mit nach nicht noch
    nur oder sein sich sie sind so und von vor war wie wir wird zu zum zur
    al como con del el ella ese esta este fue ha hay las lo los muy no o para pero por se sin su sus te tu una uno y ya""".split()
)

#: Elements that begin and end a block.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements without an end tag.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template title textarea iframe noembed noframes svg math object canvas audio video select xmp datalist".split())
#: Elements that never hold main text.
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: An element is closed when one of the same set begins right in it.
SIBLINGS = [frozenset(["p"]), frozenset(["li"]), frozenset(["dt", "dd"]), frozenset(["tr"]), frozenset(["td", "th"]), frozenset(["option"])]

NEGATIVE = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navbar|navigation|menus?|breadcrumbs?"
    r"|side-?bars?|footer|masthead|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscri(?:be|ption)|sign-?up|log-?in|search"
    r"|share|sharing|social|related|recommend(?:ed|ations)?|comments?|commentlist|replies|disqus|respond|widgets?|toolbar|paginat(?:ion|or)|pager|copyright|disclaimer"
    r"|legal|skip-?links?|toc|tags?|site-?header|page-?header|top-?bar)(?![a-z])"
)
POSITIVE = re.compile(r"(?<![a-z])(?:article|article-?body|main|main-?content|content|post|post-?(?:body|content)|entry|entry-?content|story|story-?body|text)(?![a-z])")
MARKS = re.compile(r"""(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in SKIPPED}

#: What an article element isn't, if its class or id says so.
NO_ARTICLE = re.compile(r"(?<![a-z])(?:comments?|commentlist|repl(?:y|ies)|ads?|adverts?|advertisements?|sponsor(?:ed|s)?|promos?|related|recommend(?:ed|ations)?|teasers?|widgets?)(?![a-z])")
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

#: Blocks of so many words (or visible characters, in scripts without blanks) are long; those with so many stop words among them are good by themselves.
LONG, LONG_CHARS, DENSE = 12, 80, 0.2
#: Where long blocks have fewer stop words than this, the page is in none of the languages listed, and length alone decides.
FOREIGN = 0.1
#: More of a block's characters than this in links make it bad.
LINKS = 0.5
GOOD, BAD, OPEN = 1, -1, 0


@dataclass(slots=True)
class Block:
    text: str
    outside: bool
    article: int  # number of the article or main element it stands in; 0: none
    link_chars: int
    label: int = OPEN


@dataclass(slots=True)
class _Element:
    tag: str
    outside: bool
    article: int


class _Page:
    """One pass over a page's tags."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[_Element] = []
        self.parts: list[str] = []
        self.links, self.link_chars, self.articles, self.quiet = 0, 0, 0, 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1] if self.stack else _Element("", False, 0)
                self.blocks.append(Block(text, top.outside, top.article, self.link_chars))
            self.parts.clear()
        self.link_chars = 0

    def words(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.links:
            self.link_chars += len("".join(text.split()))

    def close(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self.flush()
                del self.stack[at:]
                return
        if tag in BLOCKS:
            self.flush()

    def open(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.links = 1
            return
        if tag not in BLOCKS and tag != "button":
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        self.links = 0
        if tag in VOID:
            return
        for group in SIBLINGS:
            if tag in group:
                self._leave(group)
        if self.stack and self.stack[-1].tag == "p":
            self.stack.pop()
        top = self.stack[-1] if self.stack else _Element("", False, 0)
        marks = {k.lower(): v.strip("\"'").lower() for k, v in MARKS.findall(rest)} if rest else {}
        named = f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}"
        outside = top.outside or tag in OUTSIDE or tag == "header" and not top.article
        outside |= "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "")
        role = marks.get("role")
        outside |= role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
        article = top.article
        begins = tag in ("article", "main") or role in ("main", "article") or "articlebody" in marks.get("itemprop", "")
        if tag not in ("html", "body") and NEGATIVE.search(named.replace("_", "-")) and not (tag == "main" or begins and not NO_ARTICLE.search(named)):
            outside = True
        elif not outside and not article and (begins or tag in ("div", "section", "td") and POSITIVE.search(named.replace("_", "-"))):
            self.articles += 1
            article = self.articles
        self.stack.append(_Element(tag, outside, article))

    def _leave(self, group: frozenset[str]) -> None:
        """End the sibling that a new element of this group follows, if its parent is still open."""
        limits = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("optgroup",)}
        stop = limits.get(next(iter(group)), ("div", "article", "section", "td", "li", "blockquote", "body", "main", "nav", "aside", "footer", "header", "form"))
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in group:
                del self.stack[at:]
                return
            if self.stack[at].tag in stop:
                return


def _tag_end(page: str, at: int, last_quote: dict[str, int]) -> int:
    """Index after the > that ends the tag at this place, > in quoted values left aside; -1: none."""
    start = at
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        inner = page[start:end]
        for quote in ('"', "'"):
            if inner.count(quote) % 2 and re.search(rf"=\s*{quote}[^{quote}]*$", inner) and last_quote[quote] > end:
                at = page.find(quote, end) + 1
                break
        else:
            return end + 1
        start = at


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without labels; markup that never ends reaches to the end."""
    out, at, size = _Page(), 0, len(page)
    last_quote = {q: page.rfind(q) for q in "\"'"}
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            out.words(page[at:])
            break
        if lt > at:
            out.words(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif nxt in "!?" and nxt:
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif nxt == "/" and (name := NAME.match(page, lt + 2)):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            tag = name[0].lower()
            if tag == "a":
                out.links = 0
            elif tag in BLOCKS or tag == "button":
                out.close(tag)
                out.links = 0
        elif name := NAME.match(page, lt + 1):
            end = _tag_end(page, name.end(), last_quote)
            if end < 0:
                break
            tag, rest = name[0].lower(), page[name.end() : end - 1]
            at = end
            if tag in SKIPPED:
                if not rest.endswith("/") or tag not in ("svg", "math"):
                    found = ENDS[tag].search(page, end)
                    at = found.end() if found else size
            else:
                out.open(tag, rest)
                if tag == "button":
                    out.stack.append(_Element("button", True, 0))
        else:
            out.words("<")
            at = lt + 1
    out.flush()
    return out.blocks


@dataclass(slots=True)
class _Facts:
    """What the first pass measures of a block."""

    words: int
    stops: int
    long: bool
    linked: bool


def _facts(b: Block) -> _Facts:
    words = WORDS.findall(b.text.lower())
    visible = len(b.text) - b.text.count(" ")
    linked = b.link_chars > LINKS * visible
    return _Facts(len(words), sum(map(STOP_WORDS.__contains__, words)), len(words) >= LONG or visible >= LONG_CHARS, linked)


def _by_text(blocks: list[Block]) -> list[int]:
    """The first pass: labels from length, stop words and links alone."""
    facts = [_facts(b) for b in blocks]
    prose = [f for f, b in zip(facts, blocks) if f.long and not f.linked and not b.outside]
    foreign = sum(f.stops for f in prose) < FOREIGN * sum(f.words for f in prose)
    out = []
    for f, b in zip(facts, blocks):
        if f.linked or "©" in b.text and not b.article:
            out.append(BAD)
        elif f.long and (foreign or f.stops >= DENSE * f.words):
            out.append(GOOD)
        else:
            out.append(OPEN)
    return out


def classify(blocks: list[Block]) -> None:
    """Label every block good or bad, in two passes."""
    first = _by_text(blocks)
    good_in = any(x == GOOD and b.article and not b.outside for x, b in zip(first, blocks))
    good_out = any(x == GOOD and not b.article and not b.outside for x, b in zip(first, blocks))
    framed = any(b.article and not b.outside for b in blocks) and (good_in or not good_out)
    for x, b in zip(first, blocks):
        b.label = BAD if b.outside or framed and not b.article else x
    decided = [b.label for b in blocks]
    short = lambda b: len(WORDS.findall(b.text)) < LONG and len(b.text) < LONG_CHARS
    inside = lambda b: not b.outside and b.article > 0
    _inherit(blocks, decided, True, inside, inside)
    # a long block takes nothing from menus and footers; a short one may belong to them
    _inherit(blocks, decided, False, lambda b: not b.outside, lambda b: not short(b))
    _inherit(blocks, [b.label for b in blocks], False, lambda b: True, lambda b: True)


def _inherit(blocks: list[Block], decided: list[int], own: bool, counts: Callable[[Block], bool], takes: Callable[[Block], bool]) -> None:
    """Labels for the open blocks that take them, from the nearest decided ones that count; own: in the same article."""
    labels = [x if counts(b) else OPEN for x, b in zip(decided, blocks)]
    before, behind = _nearest(blocks, labels, own), _nearest(blocks[::-1], labels[::-1], own)[::-1]
    for b, (dist_a, a), (dist_b, c) in zip(blocks, before, behind):
        if b.label != OPEN or not takes(b):
            continue
        if OPEN in (a, c):
            b.label = a or c or GOOD  # nothing else is decided
        elif a == c or dist_a != dist_b:
            b.label = a if dist_a < dist_b else c
        else:
            b.label = GOOD


def _nearest(blocks: list[Block], labels: list[int], own: bool) -> list[tuple[int, int]]:
    """For each block, how far back the last labelled one is (own: in the same article), and its label."""
    out, at, label, article = [], 0, OPEN, 0
    for k, b in enumerate(blocks):
        if own and b.article != article:
            article, label = b.article, OPEN
        out.append((k - at, label))
        if labels[k] != OPEN:
            at, label = k, labels[k]
    return out


def main_text(page: str) -> str:
    """The good blocks of a page, one to a line."""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points).

    A row for each row.  Null and empty html give an empty text; null keys and
    urls stay null; repeated rows stay; an empty table gives an empty table;
    other columns (a text column too) are not read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    read = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    out = read.mapInArrow(run, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
