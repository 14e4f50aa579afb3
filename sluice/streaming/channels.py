"""Watermarks of channels as a stream: a failed message holds its channel's watermark until it succeeds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Channel(StatefulProcessor):
    """A channel's last id, and its open failures, each with the highest id done between it and the next.

    When a failed message succeeds, what lies behind it joins what lies before.
    So the state grows with the failures that are open, not with the messages.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("channel", "last_id long, failed array<long>, done array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, failed, done = self.state.get() if self.state.exists() else (None, [], [])
        failed, done, before = [*failed], [*done], last
        batch = pd.concat(list(rows)).sort_values(["msg_id", "ok"])
        for i, ok in zip(batch["msg_id"].tolist(), batch["ok"].tolist(), strict=True):
            at = bisect_left(failed, i)
            known = at < len(failed) and failed[at] == i
            if ok and known:
                i = max(i, done[at])
                del failed[at], done[at]
            if ok and at:
                done[at - 1] = max(done[at - 1], i)
            elif ok:
                last = i if last is None else max(last, i)
            elif not known and (last is None or i > last):
                failed.insert(at, i)
                # what was done behind the failure before may lie behind this one
                behind = done[at - 1] if at and done[at - 1] > i else 0
                if behind:
                    done[at - 1] = 0
                done.insert(at, behind)
        self.state.update((last, failed, done))
        if last != before:
            yield pd.DataFrame([(key[0], last, len(failed))], columns=["chat_id", "last_id", "n_failed"])

    def close(self) -> None:
        pass


def watermark_stream(results: DataFrame) -> DataFrame:
    """The steps of each channel's watermark in a stream of `results` (chat_id, msg_id, ok): chat_id, last_id, n_failed; needs the RocksDB state store (`rocksdb_state`).

    `last_id` is the highest id done below the lowest open failure, none at first
    (an id of 0 is a step too), and never falls: a failure at or below it is late and holds nothing. A
    message may come again; once it succeeds its failure is closed. Where
    messages first come in the order of ids, as feeds send them, the last step
    equals `advance_watermark` on all results with each message's success, if it
    had one, however the stream is cut into batches.
    """
    slim = results.where("chat_id is not null and msg_id is not null and ok is not null").select("chat_id", "msg_id", "ok")
    return slim.groupBy("chat_id").transformWithStateInPandas(Channel(), "chat_id long, last_id long, n_failed int", "append", "none")
