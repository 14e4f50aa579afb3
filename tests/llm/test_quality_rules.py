"""Weak supervision against expectation-maximisation in numpy, and on planted kinds of documents."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import quality_rules as q


def brute_fit(votes: np.ndarray, names: list[str], rounds: int) -> np.ndarray:
    """Posterior of the good class of every row of `votes` (documents x rules), one document at a time."""
    kinds = ["good", *q.KINDS]
    prior = np.array([[q.GOOD if k == "good" else q.OWN if c in q.KINDS[k] else q.OTHER for c in names] for k in kinds])
    share0 = np.array([q.START] + [(1 - q.START) / len(q.KINDS)] * len(q.KINDS))
    share, table = share0, prior
    place = np.select([votes == 1, votes == 0], [0, 1], 2)
    pseudo = q.PRIOR_SHARE * len(votes) + 1
    for k in range(rounds + 1):
        likelihood = np.array([s * np.prod([t[r, place[:, r]] for r in range(len(names))], axis=0) for s, t in zip(share, table, strict=True)])
        posterior = likelihood / likelihood.sum(0)
        if k == rounds:
            return posterior[0]
        share = (posterior.sum(1) + pseudo * share0) / (len(votes) + pseudo)
        seen = np.array([[[p[place[:, r] == v].sum() for v in range(3)] for r in range(len(names))] for p in posterior])
        table = (seen + pseudo * prior) / (posterior.sum(1)[:, None, None] + pseudo)


@pytest.mark.parametrize("n", [1, 7, 500])
def test_posteriors_are_those_of_brute_force(spark, n):
    names = list(q.votes())
    votes = np.random.default_rng(n).choice([-1, 0, 1], (n, len(names)), p=[0.15, 0.15, 0.7])
    df = spark.createDataFrame([(k, *map(int, v)) for k, v in enumerate(votes)], ["id", *names]).withColumn("pattern", q.pattern({c: F.col(c) for c in names}))
    patterns = df.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("slots", q.slots(len(names)))
    judged = q.posteriors(patterns, q.fit(patterns, names)).select("pattern", "p")
    found = {r.id: r.p for r in df.join(judged, "pattern").select("id", "p").collect()}
    expected = brute_fit(votes, names, q.ROUNDS)
    assert max(abs(found[k][0] - expected[k]) for k in range(n)) < 1e-9
    assert all(abs(sum(p) - 1) < 1e-9 for p in found.values())


def test_a_lone_alarm_is_outvoted_and_shared_ones_decide(spark):
    """Lists that repeat a line trip one rule, junk trips two of a kind."""
    rng = random.Random(5)
    word = lambda: rng.choice("the of and told some more here once again things".split()) + str(rng.randrange(400))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    clean = [(k, "\n".join(line(12) for _ in range(8))) for k in range(300)]
    lists = [(1000 + k, "\n".join(x for _ in range(3) for x in (line(20), "so it."))) for k in range(12)]
    piped = [(2000 + k, " | ".join(word() for _ in range(90)) + ".") for k in range(20)]
    marked = [(3000 + k, " ".join(word() + rng.choice(["%%%", "###"]) for _ in range(90)) + ".") for k in range(20)]
    shouted = [(4000 + k, " ".join(word().upper() + "Q!!!" for _ in range(90))) for k in range(20)]
    df = spark.createDataFrame(clean + lists + piped + marked + shouted, "doc_id long, text string")
    alarms = q.text_stats(df).select("doc_id", *(F.when(v == -1, k).alias(k) for k, v in q.votes().items()))
    tripped = {r.doc_id: [x for x in r[1:] if x] for r in alarms.collect()}
    assert all(tripped[i] == ["lines"] for i, _ in lists)
    out = {r.doc_id: r for r in q.quality_rules(df).collect()}
    kept = collections.Counter((i // 1000, r.kept) for i, r in out.items())
    assert kept == {(0, True): 300, (1, True): 12, (2, False): 20, (3, False): 20, (4, False): 20}
    assert not any(r.base_failed for r in out.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a " * 300_000), (3, "a " * 300_000)], "doc_id long, text string").withColumn("pattern", F.lit("clash")).withColumn("kept", F.lit(7))
    out = q.quality_rules(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in out) == [(0, 2, 0, True, False), (1, 0, 0, True, False), (2, 0, 0, True, False), (3, 300_000, 300_000, True, False), (3, 300_000, 300_000, True, False)]
