"""The delivery queue as a stream: rows of users wait in keyed state, and timers send them again."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.operators.route import BASE_SECONDS, MAX_ATTEMPTS, MAX_SECONDS
from sluice.streaming import AT_ONCE, BUCKETS, bucket

#: What happens to a user's rows: one is queued, a send of it ends, or the user comes back or leaves.
EVENTS = "user_id long, kind string, notification_id long, ts timestamp, outcome string, retry_after_s long, error string, active boolean"
#: Kinds of events in the order in which those of one time are taken.
KINDS = {"active": 0, "outcome": 1, "queued": 2}
LAST = 2**63 - 1
CHANGES = "user_id long, notification_id long, change long, status string, attempts int, last_error string, next_ms long, updated_ms long, active boolean"
TYPES = {"notification_id": "Int64", "status": object, "attempts": "int32", "last_error": object, "next_ms": "Int64", "active": bool}


class User:
    """A user's rows that aren't sent yet, when each is due, and whether the user is active."""

    __slots__ = ("id", "active", "clock", "change", "rows", "due", "times", "waiting", "out")

    def __init__(self, out: list[tuple], user_id: int, active: bool = True, clock: int = 0, change: int = 0) -> None:
        self.out, self.id, self.active, self.clock, self.change = out, user_id, active, clock, change
        self.rows: dict[int, tuple] = {}
        self.due: dict[int, list[int]] = {}
        self.times: list[int] = []
        self.waiting: set[int] = set()

    def put(self, i: int, status: str, attempts: int, error: str, next_ms: int | None, now: int, waits: bool = True) -> None:
        """A row's new state; a row that is done or given up is forgotten."""
        self.change += 1
        self.out.append((self.id, i, self.change, status, attempts, error, next_ms, now, self.active))
        if waits:
            self.rows[i] = (status, attempts, error, next_ms)
        else:
            self.rows.pop(i, None)

    def send(self, i: int, now: int) -> None:
        _, attempts, error, next_ms = self.rows[i]
        self.put(i, "Sending", attempts + 1, error, next_ms, now)

    def plan(self, i: int, at: int) -> None:
        if at not in self.due:
            heapq.heappush(self.times, at)
        self.due.setdefault(at, []).append(i)

    def run_due(self, until: int) -> None:
        while self.times and self.times[0] <= until:
            at = heapq.heappop(self.times)
            for i in sorted(self.due.pop(at)):
                if self.active:
                    self.send(i, at)
                else:
                    self.waiting.add(i)
            self.clock = max(self.clock, at)

    def queued(self, i: int, now: int) -> None:
        if i in self.rows:
            return
        self.put(i, "Pending", 0, "", None, now)
        if self.active:
            self.send(i, now)
        else:
            self.waiting.add(i)

    def ended(self, i: int, outcome: str, retry_after_s: float | None, error: str, now: int) -> None:
        status, attempts, _, next_ms = self.rows.get(i, (None, 0, None, None))
        if status != "Sending":
            return
        again = attempts < MAX_ATTEMPTS
        if outcome == "ok":
            self.put(i, "Sent", attempts, "", None, now, waits=False)
        elif outcome == "forbidden":
            self.active = False
            self.put(i, "Failed", attempts, error, next_ms, now, waits=again)
            if again:
                self.waiting.add(i)
        else:
            limited = outcome == "rate_limited"
            at = now + 1000 * (int(retry_after_s) if limited else min(MAX_SECONDS, BASE_SECONDS * 2**attempts))
            self.put(i, "Failed", attempts, error, at if again or limited else next_ms, now, waits=again)
            if again:
                self.plan(i, at)

    def turned(self, active: bool, now: int) -> None:
        self.active = active
        for w in sorted(self.waiting) if active else []:
            self.waiting.discard(w)
            self.send(w, now)


class Delivery(StatefulProcessor):
    """The users of a bucket, their rows that aren't sent yet, when each is due, and whether their user is active.

    Events are taken by time; before each, the sends of its user that fall due up
    to its time are made, so the result doesn't depend on how the stream is cut
    into batches. A user's clock never runs back: an event from before counts as
    happening now. Timers make the sends that no event precedes. A bucket's users
    and rows are one value, read and written once a batch, with one timer: for
    the row that is due next. Changes go out some thousands at a time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState(
            "bucket",
            "timer_ms long, user_ids array<long>, active array<boolean>, clock_ms array<long>, change array<long>, "
            "owners array<long>, ids array<long>, status array<string>, attempts array<int>, last_error array<string>, next_ms array<long>, due_ms array<long>, waits array<boolean>",
        )

    def load(self) -> None:
        self.timer, *columns = self.bucket.get() if self.bucket.exists() else (None, *([] for _ in range(12)))
        self.out: list[tuple] = []
        self.users = {u[0]: User(self.out, *u) for u in zip(*columns[:4], strict=True)}
        for owner, i, *row, due, waits in zip(*columns[4:], strict=True):
            user = self.users[owner]
            user.rows[i] = tuple(row)
            if due is not None:
                user.plan(i, due)
            if waits:
                user.waiting.add(i)

    def save(self) -> Iterator[pd.DataFrame]:
        first = min((u.times[0] for u in self.users.values() if u.times), default=None)
        if self.timer != first:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if first is not None:
                self.handle.registerTimer(first)
        users, rows = [], []
        for u in self.users.values():
            users.append((u.id, u.active, u.clock, u.change))
            due = {i: at for at, ids in u.due.items() for i in ids}
            rows += [(u.id, i, *row, due.get(i), i in u.waiting) for i, row in u.rows.items()]
        self.bucket.update((first, *([u[k] for u in users] for k in range(4)), *([r[k] for r in rows] for k in range(8))))
        if self.out:
            yield self.told()

    def told(self) -> pd.DataFrame:
        """The changes that haven't gone out yet."""
        names = [c.split(" ")[0] for c in CHANGES.split(", ")]
        out = pd.DataFrame({c: pd.array(v, dtype=TYPES.get(c, "int64")) for c, v in zip(names, zip(*self.out, strict=True), strict=True)})
        self.out.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        batch = pd.concat(list(rows))
        ids = [None if i is None or i != i else int(i) for i in batch["notification_id"].tolist()]
        batch = batch.assign(notification_id=pd.Series(ids, index=batch.index, dtype=object))
        order = np.lexsort(([LAST if i is None else i for i in ids], batch["kind"].map(KINDS).fillna(len(KINDS)), batch["ts_ms"]))
        columns = (batch[c].to_numpy()[order].tolist() for c in ("user_id", "kind", "notification_id", "outcome", "retry_after_s", "error", "active", "ts_ms"))
        for user_id, kind, i, outcome, retry_after_s, error, active, ts_ms in zip(*columns, strict=True):
            user = self.users.get(user_id)
            if user is None:
                user = self.users[user_id] = User(self.out, user_id)
            now = max(ts_ms, user.clock)
            user.run_due(now)
            user.clock = now
            if kind == "queued":
                user.queued(i, now)
            elif kind == "outcome":
                user.ended(i, outcome, retry_after_s, error, now)
            elif kind == "active":
                user.turned(bool(active), now)
            if len(self.out) >= AT_ONCE:
                yield self.told()
        yield from self.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.timer = None  # this one has gone off
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for user in self.users.values():
            user.run_due(until)
        yield from self.save()

    def close(self) -> None:
        pass


def delivery_stream(events: DataFrame, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Every change of the queue rows of a stream of `events` (EVENTS), numbered by user; needs the RocksDB state store (`rocksdb_state`).

    A queued row is sent at once if its user is active, else when the user comes
    back. Sends end as in `apply_outcomes`: failed ones fall due after the retry
    delay, a forbidden one makes the user inactive, and rows without attempts
    left stay as they are. The state holds the rows that still may be sent, so it
    is bounded by what waits. Rows fall due when the watermark, which follows the
    latest event by `delay`, or an event of their user has passed their time.
    """
    timed = events.withColumn("clock", F.col("ts")).withWatermark("clock", delay).drop("clock").withColumn("ts_ms", F.coalesce(F.unix_millis("ts"), F.lit(0))).drop("ts")
    # as text, ids keep all their digits beside nulls
    keyed = timed.where("user_id is not null").withColumns({"notification_id": F.col("notification_id").cast("string"), "bucket": bucket(F.col("user_id"), buckets)})
    return keyed.groupBy("bucket").transformWithStateInPandas(Delivery(), CHANGES, "append", "eventTime")


def queue_after(changes: DataFrame) -> DataFrame:
    """The queue that changes lead to: the last of each row."""
    last = F.max_by(F.struct("status", "attempts", "last_error", "next_ms", "updated_ms"), "change").alias("last")
    out = changes.groupBy("user_id", "notification_id").agg(last).select("user_id", "notification_id", "last.*")
    return out.withColumns({"next_attempt_at": F.timestamp_millis("next_ms"), "updated_at": F.timestamp_millis("updated_ms")}).drop("next_ms", "updated_ms")


def users_after(changes: DataFrame) -> DataFrame:
    """Whether each user was active at their last change."""
    return changes.groupBy("user_id").agg(F.max_by("active", "change").alias("is_active"))
