"""Catching up in a stream against the batch rule and against a walk by hand."""

from __future__ import annotations

import random

import pytest

from sluice.sources import feeds
from sluice.streaming import catchup


def run(spark, path, batches, **how):
    for rows in batches:
        spark.createDataFrame(rows, catchup.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(catchup.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    catchup.catchup_stream(arriving, **how).writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema(catchup.FOUND).parquet(f"{path}/out").collect()))


def poll(source, seq, *pages):
    return (source, seq, [list(p) for p in pages], None, None)


def done(source, seq, uid, ok=True):
    return (source, seq, None, uid, ok)


def cut_in(rows, n):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def test_rules(spark, tmp_path):
    rows = [
        poll("a", 1), poll("a", 2, "cba", "zzz"),  # an empty poll seeds nothing; then the first page alone is seen
        poll("a", 3, "ed", "fb", "g"), done("a", 4, "e"), done("a", 5, "d", False), done("a", 6, "f", None),  # stops at the page with b
        poll("a", 7, "he", "dx"),  # e is seen now, so page 2 isn't walked
        poll("a", 8, ["i", None, "h"], [], "y"), (None, 9, None, "q", True),  # an empty page ends the walk
        poll("a", 10, "jk", "kj", "c"),  # each once, at its oldest place
        poll("b", 1, "p"), poll("b", 2, "r", "s", "t"),  # no more pages than allowed
    ]
    a = [("a", 3, "d", 2), ("a", 3, "e", 3), ("a", 3, "f", 1), ("a", 7, "h", 1), ("a", 8, "h", 1), ("a", 8, "i", 2), ("a", 10, "j", 1), ("a", 10, "k", 2)]
    assert run(spark, tmp_path / "one", [rows], max_pages=3) == sorted([*a, ("b", 2, "t", 1), ("b", 2, "s", 2), ("b", 2, "r", 3)])
    assert run(spark, tmp_path / "many", cut_in(rows, 5), max_pages=2) == sorted([*a, ("b", 2, "s", 1), ("b", 2, "r", 2)])


def test_equals_the_batch_rule(spark, tmp_path):
    """Three polls of two sources, some of whose projects fail; the second source's seen ids go past the bound."""
    rng = random.Random(4)
    size, found, events = 60, [], []
    seen = spark.createDataFrame([], "poll_source string, uid string, seen_seq long")
    for source, count in (("a", 0), ("b", 700)):
        events.append(poll(source, 1, [f"{k}" for k in range(count + 20)][::-1]))
    seen = spark.createDataFrame([(s, f"{k}", n - k) for s, n in (("a", 20), ("b", 720)) for k in range(n)], seen.schema)
    top = {"a": 20, "b": 720}
    for seq in (1000, 2000, 3000):
        rows = []
        for source in top:
            top[source] += rng.randrange(30, 90)
            ids = [f"{k}" for k in range(top[source] - 1, -1, -1)][: size * 4]
            events.append(poll(source, seq, *(ids[k : k + size] for k in range(0, len(ids), size))))
            rows += [(source, u, k + 1, k // size + 1) for k, u in enumerate(ids)]
        seen = spark.createDataFrame(feeds.trim_seen(seen, size).collect(), "poll_source string, uid string, seen_seq long")
        new = feeds.feed_catchup(spark.createDataFrame(rows, "poll_source string, uid string, feed_rank long, page int"), seen).orderBy("poll_source", "arrival").collect()
        found += [(r.poll_source, seq, r.uid, r.arrival) for r in new]
        ended = [(r.poll_source, r.uid, rng.random() < 0.6, seq + r.arrival) for r in new]
        events += [done(s, at, u, ok) for s, u, ok, at in ended]
        seen = feeds.mark_seen(seen, spark.createDataFrame(ended, "poll_source string, uid string, ok boolean, seen_seq long"))
    assert len(found) > 100
    assert run(spark, tmp_path / "one", [events], page_size=size) == sorted(found)
    assert run(spark, tmp_path / "many", cut_in(events, 4), page_size=size) == sorted(found)


@pytest.mark.parametrize("page_size", [30, 60])
def test_the_oldest_ids_go(page_size):
    s = catchup.Source(page_size, 10)
    seen: dict[str, None] = {}
    for k in range(1000):
        s.see(seen, str(k))
    assert [*seen] == [str(k) for k in range(1000 - max(500, 10 * page_size), 1000)]
