"""Keys of a stateful stream are held by the bucket: a call of its processor serves many, and none loses its own."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from test_stream_state import Clock, started

from sluice.streaming import delivery, stream, sweep

T0 = dt.datetime(2024, 1, 1)


class Gone:
    """A timer that has gone off."""

    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_one_call_serves_the_users_of_a_bucket():
    processor, n = delivery.Delivery(), 300
    handle = started(processor)
    rows = [(u, "queued", u, None, None, None, None, 1000) for u in range(n)] + [(u, "outcome", u, "error" if u % 2 else "ok", None, "no", None, 2000) for u in range(n)]
    events = pd.DataFrame(rows, columns=["user_id", "kind", "notification_id", "outcome", "retry_after_s", "error", "active", "ts_ms"])
    changes = pd.concat(processor.handleInputRows((7,), iter([events[:350], events[350:]]), Clock()))
    assert changes.groupby("user_id").size().to_dict() == dict.fromkeys(range(n), 3)
    assert (changes.user_id == changes.notification_id).all() and (changes.status == "Sent").sum() == n // 2
    assert handle.value.calls <= 3 and handle.timers == {12_000}
    # the sends that fail are made again by one timer of the bucket
    handle.timers.clear()
    again = pd.concat(processor.handleExpiredTimer((7,), Clock(), Gone(12_000)))
    assert again.status.tolist() == ["Sending"] * (n // 2) and sorted(again.user_id) == list(range(1, n, 2)) and not handle.timers


def test_changes_go_out_some_at_a_time():
    processor = delivery.Delivery()
    started(processor)
    n = delivery.AT_ONCE
    events = pd.DataFrame({"user_id": range(n), "kind": "queued", "notification_id": range(n), "outcome": None, "retry_after_s": None, "error": None, "active": None, "ts_ms": 1000})
    sizes = [len(x) for x in processor.handleInputRows((7,), iter([events]), Clock())]
    assert sum(sizes) == 2 * n and max(sizes) <= n + 1


def test_long_ids_keep_their_digits_beside_nulls(spark, tmp_path):
    """Ids past 2 ** 53 in a batch with events that name no notification, and users of one stream apart."""
    big = 2**60 + 1
    rows = [(u, "queued", big + u, T0, None, None, None, None) for u in range(40)] + [(u, "active", None, T0 + dt.timedelta(seconds=1), None, None, None, True) for u in range(40)] + [(None, "active", None, T0, None, None, None, True)]
    spark.createDataFrame(rows, delivery.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    changes = delivery.delivery_stream(spark.readStream.schema(delivery.EVENTS).parquet(f"{tmp_path}/in"), "0 seconds", buckets=4)
    query = changes.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.user_id, r.notification_id, r.status) for r in delivery.queue_after(spark.read.schema(delivery.CHANGES).parquet(f"{tmp_path}/out")).collect()}
    assert got == {(u, big + u, "Sending") for u in range(40)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_claims_of_times_past_2262_and_long_ids_beside_nulls(spark, tmp_path):
    """What pandas' times and floats can't hold comes back as it went; projects of a bucket are told apart, and claims that ran out go."""
    at = lambda year: dt.datetime(year, 5, 6, 7, 8, 9, 123456)
    schema = "project_id string, job_uuid string, ts timestamp, seq long, seen timestamp"
    batches = [[("1", "a", at(2400), 2**60 + 1, None), ("2", "b", at(1500), None, at(2401)), (None, "n", None, 7, at(9999))], [("1", "c", at(2400), None, None), ("2", "d", at(2400), 2**60 + 3, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    marked = stream.claim_stream(arriving, ttl_seconds=3600, buckets=2)
    assert [f.simpleString() for f in marked.schema] == [f.strip().replace(" ", ":").replace("long", "bigint") for f in schema.split(",")] + ["claimed:boolean"]
    marked.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(marked.schema).parquet(f"{tmp_path}/out")
    text = lambda df, *more: {tuple(r) for r in df.select("project_id", "job_uuid", F.col("ts").cast("string"), "seq", F.col("seen").cast("string"), *more).collect()}
    assert text(out) == text(spark.read.schema(schema).parquet(f"{tmp_path}/in"))
    assert {r.job_uuid: r.claimed for r in out.collect()} == {"a": True, "b": True, "n": True, "c": False, "d": True}


def test_one_call_serves_the_projects_of_a_bucket():
    processor, n = stream.Claims(10), 200
    handle = started(processor)
    handle.value.clear = lambda: handle.value.update(None)
    claims = pd.DataFrame({"claim_key": [str(k % n) for k in range(2 * n)] + [None], "job_uuid": [f"j{k:03}" for k in range(2 * n)] + ["n"], "ts_ms": range(2 * n + 1)})
    out = pd.concat(processor.handleInputRows((7,), iter([claims]), Clock())).sort_index()
    assert out.claimed.tolist() == [True] * n + [False] * n + [True]
    assert handle.value.calls <= 3 and handle.timers == {10_001}
    handle.timers.clear()
    list(processor.handleExpiredTimer((7,), Clock(), Gone(10_001)))
    assert len(handle.value.held[1]) == n - 1 and handle.timers == {10_002}


def test_one_call_serves_the_posts_of_a_bucket():
    processor, n = sweep.Sweep(300), 200
    handle = started(processor)
    handle.value.clear = lambda: handle.value.update(None)
    rows = [(f"j{k}", "accepted", None, None, 1000) for k in range(n)] + [(f"j{k}", "guard", None, "do_not_notify", 2000) for k in range(0, n, 4)] + [(f"j{k}", "sent", k % 2 == 1, None, 3000) for k in range(n)]
    events = pd.DataFrame(rows, columns=["job_uuid", "kind", "ok", "guard", "ts_ms"])
    changes = pd.concat(processor.handleInputRows((7,), iter([events[250:], events[:250]]), Clock()))
    last = changes[changes.kind == "status"].groupby("job_uuid").status.last()
    assert last.value_counts().to_dict() == {"Complete": n // 2, "Suppressed": n // 4, f"{sweep.LEG}: Failed": n // 4}
    assert handle.value.calls <= 3 and handle.timers == {300_000} and len(handle.value.held[1]) == n // 4
    handle.timers.clear()
    again = pd.concat(processor.handleExpiredTimer((7,), Clock(), Gone(300_000)))
    assert sorted(again.job_uuid) == sorted(f"j{k}" for k in range(2, n, 4)) and handle.timers == {600_000}
