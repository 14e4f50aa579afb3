"""Watermarks in a stream against the batch rule, however the stream is cut."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluice.sources import feeds
from sluice.streaming import channels

RESULTS = "chat_id long, msg_id long, ok boolean"


def run(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    channels.watermark_stream(arriving).writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return {r.chat_id: r.last_id for r in spark.read.parquet(f"{path}/out").groupBy("chat_id").agg(F.max("last_id").alias("last_id")).collect()}


@pytest.mark.parametrize(("seed", "cuts"), [(1, 1), (2, 2), (3, 5)])
def test_equals_the_batch_rule(spark, tmp_path, seed, cuts):
    """Failures are tried again later, out of order; some never succeed."""
    rng = random.Random(seed)
    first = [(c, i, rng.random() < 0.8) for i in range(1, 60) for c in (1, 2, 3) if rng.random() < 0.7]
    again = [(c, i, rng.random() < 0.7) for c, i, ok in first if not ok]
    rng.shuffle(again)
    rows = first + again
    size = -(-len(rows) // cuts)
    got = run(spark, tmp_path, [rows[k : k + size] for k in range(0, len(rows), size)])
    best = spark.createDataFrame(rows, RESULTS).groupBy("chat_id", "msg_id").agg(F.bool_or("ok").alias("ok"))
    want = {r.chat_id: r.last_id for r in feeds.advance_watermark(best, spark.createDataFrame([], "chat_id long, last_id long")).collect()}
    assert {c: got.get(c, 0) for c in want} == want


def test_late_failures_hold_nothing(spark, tmp_path):
    got = run(spark, tmp_path, [[(1, 5, True)], [(1, 3, False), (1, 8, False), (1, 9, True), (None, 1, True)], [(1, 12, False), (1, 10, True), (1, 8, True)], [(1, 12, True)]])
    assert got == {1: 12}
