"""Claims of projects: successor pointers in batch, keyed state in streams, and the tables that are deleted with a batch."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest

from sluice.operators import claims
from sluice.sources import store
from sluice.sources.lexicon import compile_lexicon, lexicon_table, prose_profiles
from sluice.streaming import stream

CLAIM = "project_id string, job_uuid string, ts timestamp"


def day(d: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


def by_turns(rows, ttl=dt.timedelta(days=30)):
    """Owners by walking through each project's claims."""
    out = set()
    for project in {p for p, _, _ in rows}:
        last = None
        for ts, job in sorted((ts, job) for p, job, ts in rows if p == project):
            if last is None or ts > last + ttl:
                last = ts
                out.add((project, job, ts))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_owners_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("12345"), f"j{rng.randrange(30)}", day(rng.randrange(0, 1500) / 2)) for _ in range(1200)]
    rows += [("hot", f"k{k}", day(k / 50)) for k in range(4000)] + [("edge", "a", day(0)), ("edge", "b", day(30)), ("edge", "c", day(60.0001))]
    got = {(r.project_id, r.owner, r.claimed_at) for r in claims.claim_owners(spark.createDataFrame(rows, CLAIM)).collect()}
    assert got == by_turns(rows)


def test_long_history_takes_few_rounds(spark, monkeypatch):
    """A thousand lifetimes in some ten rounds."""
    rounds, real = [], claims.cut
    monkeypatch.setattr(claims, "cut", lambda df, name: (rounds.append(name), real(df, name))[1])
    rows = [("p", f"j{k}", day(31 * k)) for k in range(1000)] + [("p", f"k{k}", day(31 * k + 5)) for k in range(1000)]
    got = claims.claim_owners(spark.createDataFrame(rows, CLAIM)).collect()
    assert {r.owner for r in got} == {f"j{k}" for k in range(1000)}
    assert rounds.count("claim-owners") <= 12


def test_no_claims(spark):
    empty = spark.createDataFrame([], CLAIM)
    assert claims.claim_projects(empty).count() == 0


def land(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_stream_owner_is_the_first_to_arrive(spark, tmp_path):
    """Out of order, at the end of a lifetime, after it, and when the state has gone; no row is lost, late or not."""
    batches = [[("1", "a", day(10)), (None, "n", day(10))], [("1", "early", day(5)), ("1", "last", day(40))], [("1", "next", day(40.01)), ("2", "z", day(100))], [("1", "late", day(41))], [("1", "again", day(99))]]
    query = stream.claim_stream(land(spark, tmp_path, batches, CLAIM), delay="0 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.job_uuid: r.claimed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # at the watermark of day 100 the claim of day 40 has run out, so the late post owns from then on
    assert got == {"a": True, "n": True, "early": False, "last": False, "next": True, "z": True, "late": True, "again": False}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0


def test_stream_triage_with_claims(spark, tmp_path):
    """Posts of two sources on one project: the one that came first stays, whatever its time; the tables cut for a batch are gone."""
    post = lambda s, k, d, project: (s, str(k), s, f"of the of the\nin the of the and with that\nhttps://example.org/project/{project}", day(d))
    batches = [[post("one", 1, 10, 7), post("one", 2, 10, 8)], [post("two", 3, 5, 7), post("one", 1, 10, 7)], [post("two", 4, 60, 7)]]
    schema = "identity string, job_id string, source string, text string, ts timestamp"
    profiles, lexicon = prose_profiles(spark), store.cut(compile_lexicon(lexicon_table(spark)), "lexicon", keep=True)
    shared = Path(store.shared_dir(spark))
    arriving, before = land(spark, tmp_path, batches, schema), {p.name for p in shared.iterdir()}
    stream.run_stream(arriving, profiles, lexicon, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {r.job_id: r.decision_reason for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(got) == ["1", "2", "3", "4"]
    assert {k for k, v in got.items() if v == claims.DUPLICATE} == {"3"}
    assert {p.name for p in shared.iterdir()} == before


def test_scratch_and_clear(spark):
    shared = Path(store.shared_dir(spark))
    exists = lambda name: any(p.name.startswith(name) for p in shared.iterdir())
    kept, outer = store.cut(spark.range(3), "kept-one", keep=True), store.cut(spark.range(3), "outer-one")
    with store.scratch(spark):
        store.cut(spark.range(3), "inner-one")
        assert exists("inner-one")
    assert not exists("inner-one") and outer.count() == 3
    assert store.clear(spark) >= 1 and not exists("outer-one")
    assert kept.count() == 3
