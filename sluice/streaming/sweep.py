"""Notifications of accepted posts as a stream: states, and sends repeated by a sweep until one succeeds or the guard stops them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.streaming import AT_ONCE, BUCKETS, bucket

SWEEP_SECONDS = 300
#: What happens to a post: it is accepted, a send of it ends (`ok`), or the guard says something about it.
EVENTS = "job_uuid string, kind string, ts timestamp, ok boolean, guard string"
CHANGES = "job_uuid string, change long, kind string, status string, sends long, updated_ms long"
LEG = "Telegram"


class Post:
    """An accepted post that is neither complete nor suppressed: its state, the guard's latest word, and when it is swept next."""

    __slots__ = ("id", "status", "guard", "next", "clock", "change", "every", "out")

    def __init__(self, out: list[tuple], every: int, job_uuid: str | None, status: str, guard: str | None, next_ms: int, clock_ms: int, change: int) -> None:
        self.out, self.every = out, every
        self.id, self.status, self.guard, self.next, self.clock, self.change = job_uuid, status, guard, next_ms, clock_ms, change

    def put(self, kind: str, sends: int, now: int) -> None:
        self.change += 1
        self.out.append((self.id, self.change, kind, self.status, sends, now))

    def run_due(self, until: int) -> None:
        if self.next <= until:
            n = (until - self.next) // self.every + 1
            self.put("send", n, self.next + (n - 1) * self.every)
            self.next += n * self.every
        self.clock = max(self.clock, until)

    def sent(self, ok: bool, now: int) -> bool:
        """The end of a send; whether the post is done."""
        done = "Complete" if ok else "Suppressed" if self.guard == "do_not_notify" else None
        self.status = done or f"{LEG}: Failed"
        self.put("status", 0, now)
        return done is not None


class Sweep(StatefulProcessor):
    """The posts of a bucket that are neither complete nor suppressed.

    Events are taken by time, after the sweeps of their post up to their time. A
    post's clock never runs back. A timer makes the sweeps that no event
    precedes; those of a post that a jump of the watermark brings at once are one
    row. A bucket's posts are one value, read and written once a batch, with one
    timer: for the post that is swept next.
    """

    def __init__(self, every_seconds: int) -> None:
        self.every = every_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("posts", "timer_ms long, ids array<string>, status array<string>, guard array<string>, next_ms array<long>, clock_ms array<long>, change array<long>")

    def load(self) -> None:
        self.timer, *columns = self.bucket.get() if self.bucket.exists() else (None, *([] for _ in range(6)))
        self.out: list[tuple] = []
        self.posts = {row[0]: Post(self.out, self.every, *row) for row in zip(*columns, strict=True)}

    def save(self) -> Iterator[pd.DataFrame]:
        rows = [(p.id, p.status, p.guard, p.next, p.clock, p.change) for p in self.posts.values()]
        first = min((p.next for p in self.posts.values()), default=None)
        if self.timer != first:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if first is not None:
                self.handle.registerTimer(first)
        if rows:
            self.bucket.update((first, *([r[k] for r in rows] for k in range(6))))
        else:
            self.bucket.clear()
        if self.out:
            yield self.told()

    def told(self) -> pd.DataFrame:
        """The changes that haven't gone out yet."""
        out = pd.DataFrame(self.out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])
        self.out.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "kind"], kind="stable")
        ended: dict[str | None, tuple[int, int]] = {}
        for job_uuid, kind, ok, guard, ts_ms in zip(*(batch[c].tolist() for c in ("job_uuid", "kind", "ok", "guard", "ts_ms")), strict=True):
            post = self.posts.get(job_uuid)
            if post is not None:
                now = max(ts_ms, post.clock)
                post.run_due(now)
                if kind == "guard":
                    post.guard = guard
                elif kind == "sent" and post.sent(ok, now):
                    ended[job_uuid] = (post.clock, post.change)
                    del self.posts[job_uuid]
            elif kind == "accepted":
                clock, change = ended.pop(job_uuid, (0, 0))
                now = max(ts_ms, clock)
                post = self.posts[job_uuid] = Post(self.out, self.every, job_uuid, "Pending", None, (now // self.every + 1) * self.every, now, change)
                post.put("status", 0, now)
                post.put("send", 1, now)
            if len(self.out) >= AT_ONCE:
                yield self.told()
        yield from self.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.timer = None  # this one has gone off
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for post in self.posts.values():
            if post.next <= until:
                post.run_due(until)
        yield from self.save()

    def close(self) -> None:
        pass


def sweep_stream(events: DataFrame, every_seconds: int = SWEEP_SECONDS, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Every change of state, and every send to make, of the posts of a stream of `events` (EVENTS), numbered by post; needs the RocksDB state store (`rocksdb_state`).

    An accepted post is Pending and sent at once. A send that succeeds completes
    it; one that fails suppresses it if the guard's latest word since it was
    accepted is do_not_notify, and else leaves it Failed. At every multiple of
    `every_seconds` the posts that are still Pending or Failed are sent again:
    rows of kind `send` count the sends up to their time. Done posts leave the
    state; what comes for posts that aren't there is ignored, so a post must not
    be accepted twice (see `run_stream`). Sweeps happen when the watermark, which
    follows the latest event by `delay`, or an event of the post has passed them.
    Posts are kept by `buckets` (see `sluice.streaming`).
    """
    timed = events.withColumn("clock", F.col("ts")).withWatermark("clock", delay).drop("clock").withColumn("ts_ms", F.coalesce(F.unix_millis("ts"), F.lit(0))).drop("ts")
    return timed.withColumn("bucket", bucket(F.col("job_uuid"), buckets)).groupBy("bucket").transformWithStateInPandas(Sweep(every_seconds), CHANGES, "append", "eventTime")


def notifications_after(changes: DataFrame) -> DataFrame:
    """The state that changes lead to, and all sends, of each post."""
    last = F.max_by(F.struct("status", "updated_ms"), F.when(F.col("kind") == "status", F.col("change"))).alias("last")
    out = changes.groupBy("job_uuid").agg(last, F.sum("sends").alias("sends"))
    return out.select("job_uuid", "last.status", F.timestamp_millis("last.updated_ms").alias("updated_at"), "sends")
