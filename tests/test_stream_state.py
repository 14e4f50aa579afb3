"""What the stateful processors keep, and how often they reach for it."""

from __future__ import annotations

import pandas as pd

from sluice.streaming import channels, delivery


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.held is not None

    def get(self):
        self.calls += 1
        return self.held

    def update(self, row):
        self.calls += 1
        self.held = row


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), set()

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def started(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def test_the_id_0_is_a_step():
    processor = channels.Channel()
    started(processor)
    results = pd.DataFrame({"chat_id": [7] * 3, "msg_id": [0, 5, 6], "ok": [True, False, True]})
    steps = pd.concat(processor.handleInputRows((7,), iter([results]), Clock()))
    assert steps.values.tolist() == [[7, 0, 1]]


def test_a_user_s_rows_are_read_and_written_once_a_batch():
    processor, n = delivery.Delivery(), 200
    handle = started(processor)
    both = [("queued", i, 1000 * i, None) for i in range(n)] + [("outcome", i, 1000 * i + 1, "error" if i % 2 else "ok") for i in range(n)]
    events = pd.DataFrame([(1, kind, i, outcome, None, "no", None, ts) for kind, i, ts, outcome in both], columns=["user_id", "kind", "notification_id", "outcome", "retry_after_s", "error", "active", "ts_ms"])
    changes = pd.concat(processor.handleInputRows((1,), iter([events]), Clock()))
    assert len(changes[changes.status == "Sent"]) == n // 2
    assert handle.value.calls <= 3 and len(handle.timers) == 1
