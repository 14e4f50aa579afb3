"""Every query with a SQL twin equals it on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sluice.plans.queries import QUERIES, SQL

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    one = lambda v: None if v is None or v is pd.NaT or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(DATA)).toPandas()
    if name not in SQL:
        assert len(found)
        return
    twin = duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(twin.columns)
    assert plain(found) == plain(twin)


@pytest.mark.parametrize(("name", "most"), [("channel_backlog", 20), ("paged_feed", 70)])
def test_whole_queries_go_past_the_small_caps(spark, name, most):
    data = DATA.parent / "sf0.01"
    if not data.is_dir():
        pytest.skip("no tables here")
    rows = QUERIES[f"{name}_whole"](spark, str(data)).toPandas()
    assert rows.groupby(rows.columns[0]).size().max() > most
