"""Repeated sends by sweeps, with a clock that the input drives."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from sluice.streaming import sweep

T0 = dt.datetime(2024, 1, 1)


def event(job, kind, s, ok=None, guard=None):
    return (job, kind, T0 + dt.timedelta(seconds=s), ok, guard)


def run(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, sweep.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(sweep.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    changes = sweep.sweep_stream(arriving, delay="0 seconds")
    changes.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sweep.CHANGES).parquet(f"{path}/out")


def walked(events, end):
    """A post at a time, second by second of interest."""
    out = {}
    for job in {e[0] for e in events}:
        status, guard, sends, at = None, None, 0, None
        mine = sorted((e for e in events if e[0] == job), key=lambda e: (e[2], e[1]))
        for k, e in enumerate(mine):
            s = int((e[2] - T0).total_seconds())
            if e[1] == "accepted" and at is None:
                status, at, sends, seen = "Pending", s, 1, s
            elif at is None or status in ("Complete", "Suppressed"):
                continue
            else:
                sends += s // 300 - seen // 300
                seen = s
                if e[1] == "guard":
                    guard = e[4]
                elif e[1] == "sent":
                    status, at = "Complete" if e[3] else "Suppressed" if guard == "do_not_notify" else "Telegram: Failed", s
        if status not in (None, "Complete", "Suppressed"):
            sends += end // 300 - seen // 300
        if status:
            out[job] = (status, sends, T0 + dt.timedelta(seconds=at))
    return out


@pytest.mark.parametrize("cuts", [1, 4])
def test_sweeps(spark, tmp_path, cuts):
    rng = random.Random(8)
    events = [event("done", "accepted", 10), event("done", "sent", 700, True), event("done", "sent", 900, False), event("silent", "accepted", 20), event("unknown", "sent", 30, True), event("exact", "accepted", 300), event("exact", "sent", 600, True)]
    for k in range(12):
        s = rng.randrange(400)
        events.append(event(f"j{k}", "accepted", s))
        for _ in range(rng.randrange(4)):
            s += rng.randrange(1, 900)
            events.append(event(f"j{k}", *rng.choice([("sent", s, False), ("sent", s, False), ("sent", s, True), ("guard", s, None, "do_not_notify"), ("guard", s, None, "error")])))
    events.sort(key=lambda e: e[2])
    size = -(-len(events) // cuts)
    batches = [events[k : k + size] for k in range(0, len(events), size)] + [[event("clock", "sent", 6010, True)]]
    changes = run(spark, tmp_path, batches)
    got = {r.job_uuid: (r.status, r.sends, r.updated_at) for r in sweep.notifications_after(changes).collect()}
    assert got == walked(events, 6010)
    assert got["done"][:2] == ("Complete", 3) and got["silent"][1] == 21 and got["exact"][1] == 2
