"""Stream variants: a polled source, event folds with bounded state, a sink for micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may come: the longest window plus the slack that dates are given.
LATENESS = "24 hours 5 minutes"


class PageFolder(DataSource):
    """Channel pages kept in a folder as ``<number>.html``; option ``path``.

    The offset is the largest page number read, which takes the place of a state
    file: a restart goes on behind it.
    """

    @classmethod
    def name(cls) -> str:
        return "page_folder"

    def schema(self) -> str:
        return "page bigint, html string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PageReader(self.options["path"])


class _PageReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _pages(self) -> list[int]:
        import pathlib

        return sorted(int(f.stem) for f in pathlib.Path(self.path).glob("*.html") if f.stem.isdigit())

    def _rows(self, pages: list[int]) -> Iterator[tuple[int, str]]:
        import pathlib

        return iter([(n, (pathlib.Path(self.path) / f"{n}.html").read_text(encoding="utf-8")) for n in pages])

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        fresh = [n for n in self._pages() if n > start["page"]]
        return self._rows(fresh), {"page": max(fresh, default=start["page"])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        return self._rows([n for n in self._pages() if start["page"] < n <= end["page"]])


def distinct_posts(events: DataFrame, time_col: str = "at") -> DataFrame:
    """Publications, each post once within the lateness; state is dropped behind the watermark."""
    return events.where("event = 'published'").withWatermark(time_col, LATENESS).dropDuplicatesWithinWatermark(["facebook_post_id"])


def hourly_counts(events: DataFrame, time_col: str = "at") -> DataFrame:
    """Posts in each hour that slides by five minutes."""
    return distinct_posts(events, time_col).groupBy(F.window(time_col, "1 hour", "5 minutes")).agg(F.count("*").alias("posts"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    published, commented, post, latest = state.get if state.exists else (-1, -1, None, 0)
    for rows in batches:
        latest = max(latest, int(rows["ms"].max()))
        out = rows[rows["event"] == "published"]
        if len(out) and out["ingest_seq"].max() > published:
            top = out.loc[out["ingest_seq"].idxmax()]
            published, post = int(top["ingest_seq"]), top["facebook_post_id"]
        commented = max(commented, int(rows.loc[rows["event"] == "comment_posted", "ingest_seq"].max() if (rows["event"] == "comment_posted").any() else -1))
    state.update((published, commented, post, latest))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep_ms)
    if published >= 0:
        yield pd.DataFrame({"telegram_id": [key[0]], "post_id": [post], "comment_posted": [commented > published]})


def delivery_state(events: DataFrame, time_col: str = "at", keep_days: float = 30) -> DataFrame:
    """Per id the latest publication and whether a comment followed it, updated as events come in any order.

    Equal to the batch fold while an item's events are at most ``keep_days``
    apart: its state goes once the watermark is that far behind its last event,
    and an event after that starts it afresh.  Events later than LATENESS, and
    those without a time, are not read.
    """
    keep_ms = int(keep_days * 86_400_000)
    timed = events.where(F.col(time_col).isNotNull()).withWatermark(time_col, LATENESS)
    rows = timed.select("telegram_id", "event", "facebook_post_id", "ingest_seq", time_col, F.unix_millis(time_col).alias("ms"))
    return rows.groupBy("telegram_id").applyInPandasWithState(
        lambda key, batches, state: _fold(key, batches, state, keep_ms),
        "telegram_id bigint, post_id string, comment_posted boolean", "published bigint, commented bigint, post string, latest bigint", "update", GroupStateTimeout.EventTimeTimeout,
    )


def append_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run work on each micro-batch; the checkpoint makes a restart go on where it stopped."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()
    while once and query.isActive:
        time.sleep(0.1)
    if query.exception():
        raise query.exception()
    return query
