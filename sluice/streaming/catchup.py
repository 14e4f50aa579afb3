"""Catching up with paged feeds as a stream: each source's seen ids are bounded keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.sources.feeds import MAX_PAGES, PAGE_SIZE

#: What happens to a source: a poll read `pages` of ids, newest first, or the project `uid` was processed (`ok`); `seq` numbers both by source.
EVENTS = "poll_source string, seq long, pages array<array<string>>, uid string, ok boolean"
FOUND = "poll_source string, seq long, uid string, arrival long"


class Source(StatefulProcessor):
    """The ids that a source was seen with, in the order of their insertion; the oldest go first."""

    def __init__(self, page_size: int, max_pages: int) -> None:
        self.most, self.max_pages = max(500, 10 * page_size), max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "uids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(self.state.get()[0]) if self.state.exists() else {}
        before, out = [*seen], []
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if e.pages is None:
                if e.ok is True and e.uid is not None:
                    self.see(seen, e.uid)
                continue
            pages = [[u for u in page if u is not None] if page is not None else [] for page in e.pages]
            if not seen:
                for uid in pages[0] if pages else []:
                    self.see(seen, uid)
                continue
            found: dict[str, None] = {}
            for uid in reversed(self.walked(seen, pages)):
                if uid not in seen:
                    found[uid] = None
            out += [(key[0], e.seq, uid, k) for k, uid in enumerate(found, 1)]
        if [*seen] != before:
            self.state.update(([*seen],))
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in FOUND.split(", ")])

    def see(self, seen: dict[str, None], uid: str) -> None:
        seen.setdefault(uid)
        if len(seen) > self.most:
            del seen[next(iter(seen))]

    def walked(self, seen: dict[str, None], pages: list[list[str]]) -> list[str]:
        """Ids of the pages up to the first with a seen id, before the first empty one, within those allowed."""
        out: list[str] = []
        for page in pages[: self.max_pages]:
            out += page
            if not page or any(uid in seen for uid in page):
                break
        return out

    def close(self) -> None:
        pass


def catchup_stream(events: DataFrame, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """New projects by poll in a stream of `events` (EVENTS): poll_source, seq, uid, arrival (oldest first, from 1); needs the RocksDB state store (`rocksdb_state`).

    A source's first poll with a project only seeds it: the ids of its first page
    are seen, and nothing is new. Later polls are walked while all is unseen, up
    to the first page with a seen id, the first empty one, or the last allowed.
    A project is seen once it was processed successfully, so one that failed is
    found again. An id that comes on several pages is found once, at its oldest
    place. A source keeps the max(500, 10 pages) ids inserted last. A source's
    events arrive in the order of `seq`, as polls follow each other; events
    without a source or number are ignored. However the stream is cut into
    batches, the result equals `feed_catchup`, `mark_seen` and `trim_seen` in turn.
    """
    slim = events.where("poll_source is not null and seq is not null").select("poll_source", "seq", "pages", "uid", "ok")
    return slim.groupBy("poll_source").transformWithStateInPandas(Source(page_size, max_pages), FOUND, "append", "none")
