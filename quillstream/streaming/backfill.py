"""A stream source that reads a channel backwards, from its newest message to those already known."""

from __future__ import annotations

import pathlib
import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources import html

#: Pages that one sweep may read before it has to meet what is known.
MAX_PAGES = 30

Row = tuple[int, int, int, str]


class Archive(Protocol):
    """Where pages come from; what lies before a cursor must not change once it was read."""

    def newest(self) -> int: ...

    def before(self, cursor: int) -> tuple[int, str] | None:
        """The page of the last messages under the cursor and its smallest number, None if there are none."""


class PageFiles:
    """Pages in a shared folder as ``<first>-<last>.html``, named by their smallest and largest message."""

    def __init__(self, path: str):
        self.path = pathlib.Path(path)

    def _spans(self) -> list[tuple[int, int, pathlib.Path]]:
        named = [(re.fullmatch(r"(\d+)-(\d+)", f.stem), f) for f in self.path.glob("*.html")]
        return [(int(m[1]), int(m[2]), f) for m, f in named if m]

    def newest(self) -> int:
        return max((last for _, last, _ in self._spans()), default=0)

    def before(self, cursor: int) -> tuple[int, str] | None:
        first, _, file = max((s for s in self._spans() if s[0] < cursor), default=(0, 0, None))
        return None if file is None else (first, file.read_text(encoding="utf-8"))


class BackwardPages(DataSource):
    """Pages of a channel by a cursor that goes backwards; options ``path``, ``known`` (0) and ``max_pages``.

    A sweep starts at the newest number and asks for the page before a cursor,
    the page's smallest number being the next cursor, one page a batch.  It ends
    where a page reaches a known number or none is left; only then does
    ``known`` move up to the number that the sweep started from, and later
    messages belong to the next sweep.  The offset holds the whole position, so
    a restart reads the same pages again and goes on behind them.  A sweep that
    needs more than ``max_pages`` pages, or a cursor that doesn't get smaller,
    is an error: going on would leave a gap that nothing fills later.

    Columns: known and top (the sweep takes numbers in between, top included),
    before (the cursor) and html.
    """

    @classmethod
    def name(cls) -> str:
        return "backward_pages"

    def schema(self) -> str:
        return "known bigint, top bigint, before bigint, html string"

    def archive(self) -> Archive:
        return PageFiles(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return BackwardReader(self.archive(), int(self.options.get("known", 0)), int(self.options.get("max_pages", MAX_PAGES)))


class BackwardReader(SimpleDataSourceStreamReader):
    def __init__(self, archive: Archive, known: int, max_pages: int):
        self.archive, self.known, self.max_pages = archive, known, max_pages

    def initialOffset(self) -> dict:
        return {"known": self.known, "top": self.known, "before": 0, "pages": 0}

    def _step(self, at: dict, top: int) -> tuple[list[Row], dict]:
        """One page on from an offset; before is 0 between sweeps, and the next sweep starts from top."""
        if not at["before"]:
            if top <= at["known"]:
                return [], at
            at = {"known": at["known"], "top": top, "before": top + 1, "pages": 0}
        done = {"known": at["top"], "top": at["top"], "before": 0, "pages": 0}
        if at["pages"] >= self.max_pages:
            raise ValueError(f"{at['pages']} pages read and messages between {at['known']} and {at['before']} are still missing; raise max_pages")
        page = self.archive.before(at["before"])
        if page is None:
            return [], done
        first, text = page
        if first >= at["before"]:
            raise ValueError(f"the page before {at['before']} begins at {first}")
        rows = [(at["known"], at["top"], at["before"], text)]
        return rows, done if first <= at["known"] + 1 else at | {"before": first, "pages": at["pages"] + 1}

    def read(self, start: dict) -> tuple[Iterator[Row], dict]:
        rows, end = self._step(start, self.archive.newest())
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Row]:
        at = start  # one step in a stream; over several sweeps, one up to the last one's top has the same messages
        while at != end:
            rows, after = self._step(at, end["top"])
            if after == at:
                raise ValueError(f"{end} can't be reached from {start}")
            yield from rows
            at = after


def messages(batch: DataFrame, now: Column | None = None, **channel) -> DataFrame:
    """Inbox rows of a batch of pages: numbers over known, up to top; of a message on several pages the one last read counts."""
    span = F.broadcast(batch.agg(F.min("known").alias("known"), F.max("top").alias("top")))  # one row
    found = html.read_messages(batch, now=now, order=-F.col("before"), **channel)
    return found.crossJoin(span).where("telegram_id > known AND telegram_id <= top").drop("known", "top")
