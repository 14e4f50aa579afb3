"""The delivery queue as a stream against folding the batch steps event by event."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import route
from sluice.streaming import delivery

T0 = dt.datetime(2024, 1, 1)
QUEUE = "seq long, notification_id long, job_uuid long, user_id long, status string, attempts int, last_error string, next_attempt_at timestamp, updated_at timestamp"


def at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


def event(user, kind, i, s, outcome=None, after=None, error=None, active=None):
    return (user, kind, i, at(s), outcome, after, error, active)


def run(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, delivery.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(delivery.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    changes = delivery.delivery_stream(arriving, "0 seconds")
    changes.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(delivery.CHANGES).parquet(f"{path}/out")


def test_retries_until_sent_or_given_up(spark, tmp_path):
    """Delays of 10, 20, 40 and 80 seconds; five attempts; a user who forbids gets nothing until they are back."""
    failing = [event(1, "outcome", 10, s, "error", None, "no") for s in (1, 12, 33, 74, 155)]
    batches = [
        [event(1, "queued", 10, 0), event(2, "queued", 20, 0), event(3, "queued", 30, 0), event(3, "queued", 31, 1)],
        [event(2, "outcome", 20, 2, "rate_limited", 100, "slow"), event(3, "outcome", 30, 2, "forbidden", None, "off"), event(3, "outcome", 31, 3, "error", None, "no"), *failing[:2]],
        [event(3, "active", None, 60, active=True), *failing[2:], event(1, "outcome", 99, 3, "ok")],
        [event(9, "active", None, 1000, active=True)],
    ]
    changes = run(spark, tmp_path, batches)
    told = lambda i: [(r.status, r.attempts, (r.updated_ms - int(T0.replace(tzinfo=dt.UTC).timestamp() * 1000)) // 1000) for r in changes.where(F.col("notification_id") == i).orderBy("change").collect()]
    assert [x for x in told(10) if x[0] == "Sending"] == [("Sending", 1, 0), ("Sending", 2, 11), ("Sending", 3, 32), ("Sending", 4, 73), ("Sending", 5, 154)]
    assert told(10)[-1] == ("Failed", 5, 155)
    # nobody says how the second send ended; a timer made it when only another user's event moved the clock
    assert told(20) == [("Pending", 0, 0), ("Sending", 1, 0), ("Failed", 1, 2), ("Sending", 2, 102)]
    assert told(30) == [("Pending", 0, 0), ("Sending", 1, 0), ("Failed", 1, 2), ("Sending", 2, 60)]
    assert told(31) == [("Pending", 0, 1), ("Sending", 1, 1), ("Failed", 1, 3), ("Sending", 2, 60)]
    assert {r.user_id: r.is_active for r in delivery.users_after(changes).collect()} == {1: True, 2: True, 3: True}


def folded(spark, events):
    """The batch steps, claim and outcome, at every time that something happens or falls due."""
    queue, users = spark.createDataFrame([], QUEUE), spark.createDataFrame([(u, True) for u in (1, 2)], "user_id long, is_active boolean")
    rows, told = {}, {}
    for e in sorted(events, key=lambda e: e[3]):
        told.setdefault(e[3], []).append(e)
    times = set(told)
    while times:
        now = min(times)
        times.discard(now)
        clock = F.lit(now)
        queue = spark.createDataFrame(sorted(rows.values()), QUEUE)
        for kind in ("due", "outcome", "queued"):
            some = [e for e in told.get(now, []) if e[1] == kind]
            if kind == "outcome" and some:
                outcomes = spark.createDataFrame([(e[2], e[4], e[5], e[6]) for e in some if rows.get(e[2], [0] * 5)[4] == "Sending"], "notification_id long, outcome string, retry_after_s int, error string")
                after = route.apply_outcomes(queue, outcomes, clock)
                users = spark.createDataFrame([tuple(r) for r in route.deactivate_users(users, after).collect()], "user_id long, is_active boolean")
                queue = spark.createDataFrame([tuple(r) for r in after.drop("deactivate").select(*queue.columns).collect()], QUEUE)
            if kind == "queued":
                new = [(e[2], e[2], 0, e[0], "Pending", 0, "", None, now) for e in some if e[2] not in rows]
                queue = queue.unionByName(spark.createDataFrame(new, QUEUE))
            if kind != "outcome":
                sending = {r.notification_id: tuple(r) for r in route.claim_batch(queue, users, clock, 1000).select(*queue.columns).collect()}
                queue = spark.createDataFrame([sending.get(r.notification_id, tuple(r)) for r in queue.collect()], QUEUE)
        rows = {r.notification_id: tuple(r) for r in queue.collect()}
        times |= {r[7] for r in rows.values() if r[4] == "Failed" and r[7] and r[7] > now}
    return {i: (r[4], r[5], r[6], r[7]) for i, r in rows.items()}


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_equals_folding_the_batch_steps(spark, tmp_path, cuts):
    rng = random.Random(4)
    events, s = [], 0.0
    for i in range(1, 6):
        events.append(event(1 + i % 2, "queued", i, i * 3.5))
    for _ in range(9):
        s += rng.choice([7, 13, 29])
        i = rng.randint(1, 5)
        events.append(event(1 + i % 2, "outcome", i, s + 0.25, rng.choice(["error", "error", "ok", "rate_limited"]), 17, "no"))
    events.append(event(1, "outcome", 4, s + 90.25, "forbidden", None, "off"))
    events.append(event(2, "queued", 50, s + 500))
    events.sort(key=lambda e: e[3])
    size = -(-len(events) // cuts)
    changes = run(spark, tmp_path, [events[k : k + size] for k in range(0, len(events), size)] + [[event(7, "active", None, s + 5000, active=True)]])
    got = {r.notification_id: (r.status, r.attempts, r.last_error, r.next_attempt_at) for r in delivery.queue_after(changes).collect()}
    assert got == folded(spark, events)
