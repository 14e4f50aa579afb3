"""Mined URL rules against brute force, and on the driver's tables."""

from __future__ import annotations

import collections
import math
import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.llm import url_filter


def brute_rules(rows, min_count, min_support, min_lift, margin):
    """All rules by enumeration: antecedent -> (n, n_bad), without those that a part of them does as well."""
    n, n_bad = len(rows), sum(bad for _, bad in rows)
    base = n_bad / n
    common = set.intersection(*(set(items) for items, _ in rows))
    every, of_bad = collections.Counter(), collections.Counter()
    for items, bad in rows:
        left = sorted(set(items) - common)
        for k in range(1, len(left) + 1):
            for part in combinations(left, k):
                every[part] += 1
                of_bad[part] += bad
    out = {}
    for part, m in every.items():
        k = of_bad[part]
        share = k / m
        low = (share + margin**2 / (2 * m) - margin * math.sqrt(share * (1 - share) / m + margin**2 / (4 * m * m))) / (1 + margin**2 / m)
        if k >= max(min_count, math.ceil(min_support * n)) and share >= min_lift * base and low > base:
            out[part] = (m, k)
    return {p: v for p, v in out.items() if not any(q in out and out[q][1] / out[q][0] >= v[1] / v[0] for q in combinations(p, len(p) - 1))}


@pytest.mark.parametrize(("seed", "min_support"), [(1, 0.0), (2, 0.01), (3, 0.03)])
def test_mined_rules_are_those_of_brute_force(spark, seed, min_support):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(9)]
    rows = []
    for _ in range(400):
        items = sorted({"everywhere", *(t for t in vocabulary if rng.random() < 0.35)})
        rows.append((items, rng.random() < (0.6 if {"t1", "t2"} <= set(items) else 0.35 if "t3" in items else 0.08)))
    df = spark.createDataFrame(rows, "items array<string>, bad boolean")
    mined = url_filter.mine(df, F.col("bad"), min_support=min_support)
    found = {tuple(r.antecedent): (r.n, r.n_bad) for r in mined.collect()}
    assert found == brute_rules(rows, url_filter.MIN_COUNT, min_support, url_filter.MIN_LIFT, url_filter.MARGIN)
    assert found


def test_copies_of_long_urls_are_one_token(spark):
    """Eight copies of a bad url with sixty parameters, and others that share some of them: mining ends, and any of the tokens blocks."""
    trap = "http://trap.example/x?" + "&".join(f"p{k}={k}" for k in range(60))
    urls = [trap] * 8 + [f"http://fine{k}.example/y" for k in range(90)] + ["http://other.example/z?p7=1", "http://other.example/z?q=1", None, "", "x" * 20_000, "http://long.example/" + "a/" * 5000]
    pages = spark.createDataFrame([(k if k != 100 else None, u, "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, items string, members string")
    labels = spark.createDataFrame([(k, int(k >= 8)) for k in range(98)] + [(None, 0), (3, None)], "doc_id long, quality int")
    out = {r.page_id: r.verdict for r in url_filter.url_filter(pages, labels).collect()}
    assert all(out[k] == "block" for k in range(8)) and out[98] == "block"
    assert {out[k] for k in [*range(8, 98), 99, 101, None, 102, 103]} == {"allow"}


def test_classes(spark):
    """Tokens of the same rows share a class; of those of the same bad rows only the one with the fewest rows is mined."""
    rows = [(["a", "b", "c"], 3, 3), (["c", "d"], 2, 0), (["d"], 1, 1)]
    got = url_filter.classes(spark.createDataFrame(rows, "items array<string>, n long, n_bad long")).collect()
    assert sorted((r.rep, r.members) for r in got) == [("a", ["a", "b"]), ("d", ["d"])]


def test_one_sided_or_few_labels_mine_nothing(spark):
    for rows in ([], [(["a"], True)] * 30, [(["a"], False)] * 30, [(["a", "b"], True)] * 2 + [(["a"], False)] * 9, [([], True)] * 9 + [(["a"], False)] * 9):
        assert url_filter.mine(spark.createDataFrame(rows, "items array<string>, bad boolean"), F.col("bad")).collect() == []


def test_rules_change_verdicts_on_the_tables(spark):
    data = Path("/root/testdata/sf0.1")
    if not data.is_dir():
        pytest.skip("no tables here")
    pages, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("pages", "labels"))
    out = url_filter.url_filter(pages, labels).where("rule is null").groupBy("verdict").count().collect()
    n = {r.verdict: r["count"] for r in out}
    assert n["block"] > 20 and n["allow"] > n["block"]
