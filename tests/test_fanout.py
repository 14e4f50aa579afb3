"""Fan-out whose subscribers are too many to broadcast: a grid for large categories."""

from __future__ import annotations

import random

from sluice.operators import route


def test_the_grid_equals_the_join(spark):
    """One category has most posts, one most takers, some have either only."""
    rng = random.Random(3)
    posts = {(k, c) for k in range(120) for c in ("all", rng.choice("abcdef"), rng.choice("wxyz")) if rng.random() < 0.7}
    takers = {(u, c) for u in range(150) for c in ("all", "a", rng.choice("bcdegh")) if rng.random() < 0.6}
    left = spark.createDataFrame(sorted(posts), "job_uuid long, category_id string")
    users = spark.createDataFrame([(u, f"x{u}", u % 5 > 0) for u in range(150)], "user_id long, external_id string, is_active boolean")
    subs = spark.createDataFrame(sorted(takers), "user_id long, category_id string")
    want = {(k, u) for k, c in posts for u, d in takers if c == d and u % 5}
    for most in (0, 1000):
        rows = [(r.job_uuid, r.user_id) for r in route.fanout(left, users, subs, broadcast_rows=most).collect()]
        assert len(rows) == len(want) and set(rows) == want
    plain = sorted((k, c, u) for k, c in posts for u, d in takers if c == d)
    got = route._dealt(left, subs, 10, 7).select("job_uuid", "category_id", "user_id").collect()
    assert sorted(map(tuple, got)) == plain
