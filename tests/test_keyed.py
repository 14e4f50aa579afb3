"""Tables by key against a dictionary that takes the same changes."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql.types import StructType

from sluice.sources.keyed import KeyedTable

SCHEMA = StructType().add("id", "string").add("name", "string").add("score", "double").add("made", "long")


def table(path, buckets=8):
    return KeyedTable(str(path), "id", SCHEMA, once=("made",), buckets=buckets)


def rows_of(t, spark):
    return {r.id: tuple(r)[1:] for r in t.read(spark).collect()}


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    t, want = table(tmp_path / "t"), {f"k{k}": ("old", None, 0) for k in range(10)}
    t.create(spark.createDataFrame([(k, *v) for k, v in want.items()], SCHEMA))
    for batch in range(1, 6):
        inserts = batch % 2 == 1
        keys = rng.sample([f"k{k}" for k in range(30)], 8)
        rows = [(k, rng.choice([None, f"n{batch}"]), rng.choice([None, float(batch)]), batch) for k in keys]
        frame = spark.createDataFrame(rows, SCHEMA)
        t.put(frame, batch, inserts)
        for k, name, score, made in rows:
            if k in want:
                held = want[k]
                want[k] = (name or held[0], held[1] if score is None else score, held[2])
            elif inserts:
                want[k] = (name, score, made)
        assert rows_of(t, spark) == want
        t.put(frame, batch, inserts)
        assert rows_of(t, spark) == want
        if batch == 3:
            t.compact(spark, 2)
            assert rows_of(t, spark) == want
            t.compact(spark, 3)
            t.compact(spark, 3)
            assert rows_of(t, spark) == want
            t.put(frame, batch, inserts)  # folded already
            assert rows_of(t, spark) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(tmp_path / "t")
    t.create(spark.createDataFrame([(f"k{k}", "old", 1.0, 0) for k in range(200)], SCHEMA))
    before = files(tmp_path / "t" / "rows")
    t.put(spark.createDataFrame([("k7", "new", None, 1)], SCHEMA), 1, inserts=False)
    assert files(tmp_path / "t" / "rows") == before
    assert len(files(tmp_path / "t" / "changes")) == 1
    t.compact(spark, 1)
    after = files(tmp_path / "t" / "rows")
    assert len(before.keys() - after.keys()) == 1 and len(after.keys() & before.keys()) == len(before) - 1 == 7
    assert not files(tmp_path / "t" / "changes")
    assert rows_of(t, spark)["k7"] == ("new", 1.0, 0) and len(rows_of(t, spark)) == 200


def test_odd_rows(spark, tmp_path):
    """Empty tables and batches, rows without a key, repeated keys, unknown columns, lists, one key in most rows."""
    t = table(tmp_path / "t")
    t.create(spark.createDataFrame([], SCHEMA))
    assert rows_of(t, spark) == {}
    t.put(spark.createDataFrame([], SCHEMA), 1)
    t.compact(spark, 1)
    assert rows_of(t, spark) == {}
    t.put(spark.createDataFrame([Row(id="early", name="lost")]), 2, inserts=False)
    odd = spark.createDataFrame([("early", ["a", "b"], 1), (None, ["x"], 1), *[("hot", [f"{k % 9}"], k) for k in range(500)]], "id string, name array<string>, other long")
    t.put(odd, 3)
    assert rows_of(t, spark) == {"early": ("a, b", None, None), "hot": ("8", None, None)}
    with pytest.raises(ValueError, match="numbered from 1"):
        t.put(odd, 0)
    with pytest.raises(ValueError, match="bucket"):
        KeyedTable("x", "id", StructType().add("id", "string").add("bucket", "integer"))
