"""The secret scan's table of pairs, gradients, calibration and threshold come from all windows, however few the fit starts from."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sluice.llm import secrets

SYLLABLES = ["an", "ber", "che", "der", "ein", "keit", "lich", "mar", "nen", "ost", "pfe", "ret", "sam", "tig", "und", "ver", "wor"]


def prose(rng, n):
    return [w.upper() if rng.random() < 0.1 else w for w in ("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 6))) for _ in range(n))]


@pytest.fixture
def texts(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_FINDINGS", 60)
    rng = random.Random(8)
    return [" ".join([*prose(rng, 30), f'token = "{rng.randbytes(20).hex()}"', f"{rng.randrange(10**8, 10**9)}", *prose(rng, 30)]) for _ in range(60)]


def frame(spark, texts, parts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def test_all_windows_take_part(spark, texts):
    docs = frame(spark, texts, 3)
    windows, labels, sums = secrets.sample(docs, 12)
    net, _ = secrets.learn(docs, 12)
    s = secrets.scan(texts)
    rank, x = secrets.ranks(s.raw), secrets.codes([r.tobytes() for r in s.raw])
    free = ~secrets.kept_back(rank)
    assert sum(~labels) == 36 and not secrets.kept_back(secrets.ranks(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, secrets.WIDTH))).any()
    assert sums.windows == {k: int((free & (s.label == k)).sum()) for k in secrets.LABELS[1:]} and sum(sums.windows.values()) > 1000
    for k in secrets.LABELS[1:]:
        assert (sums.pairs[k] == secrets.pair_counts(x[free & (s.label == k)])).all()
    assert {bytes(r.around) for r in sums.secrets.collect()} == {r.tobytes() for r in s.raw[s.label == secrets.SECRET]}
    # a step's gradients are those of all windows at once, on any number of tasks
    shares = dict.fromkeys(sums.windows, 1 / 3)
    step = [secrets.step_gradients(frame(spark, texts, n), sums, net, 2, 400, shares)[0] for n in (1, 5)]
    want, loss = {k: 0.0 for k in step[0]}, 0.0
    for label, n in sums.windows.items():
        w = secrets.STEPS / (6 * n)
        own = x[free & (s.label == label)]
        own = own[secrets.unusual(net.pairs, own)[:, 1] < net.doubt]
        of = net.gradients(own, lambda z, w=w: w * np.maximum(secrets.MARGIN + z, 0))
        want = {k: want[k] + of[k] for k in want}
    alone = secrets.step_gradients(frame(spark, texts, 2).where("false"), sums, net, 2, 400, shares)[0]  # the secrets' part
    for k in want:
        assert np.allclose(step[0][k], step[1][k], atol=1e-6) and np.allclose(step[0][k], want[k] + alone[k], atol=1e-5), k
    assert np.abs(alone["out"]).sum() > 0


def test_threshold_is_that_of_all_windows_kept_back(spark, texts):
    docs = frame(spark, texts, 3)
    net, sums = secrets.learn(docs, 12)
    back = np.concatenate([x[2] for x in secrets.scored(texts, net)])
    s = secrets.scan(texts)
    free = secrets.kept_back(secrets.ranks(s.raw)) & (s.label != secrets.SECRET) & (s.label != secrets.UNSURE)
    x = secrets.codes([r.tobytes() for r in s.raw[free]])
    assert len(back) == (secrets.unusual(net.pairs, x)[:, 1] < net.doubt).sum() > 200
    bins, n = np.unique(back, return_counts=True)
    least = secrets.least_bin(net, sums, (bins, n))
    own = secrets.codes([r.tobytes() for r in s.raw[(s.label == secrets.SECRET) & secrets.kept_back(secrets.ranks(s.raw))]])
    assert len(own) and np.mean(secrets.binned(net.logit(own)) >= least) >= secrets.RECALL
    # a secret scan adds the candidates from there on
    got = {r.doc_id: [(v.start, v.end) for v in r.spans if v.kind == "model"] for r in secrets.secret_scan(docs, 12).collect()}
    assert got == {k: [(a, b) for a, b, z in x[1].tolist() if z >= least] for k, x in enumerate(secrets.scored(texts, net))}


def test_quantiles_and_calibration_of_counts():
    bins, n = np.array([-3, 0, 5]), np.array([2, 17, 1])
    assert [secrets.quantile(bins, n, q) for q in (0.0, 0.05, 0.1, 0.94, 0.95)] == [-3, -3, 0, 0, 5]
    net = secrets.Net(*[np.zeros(1)] * 6)
    z = np.arange(-300, 300, 10)
    many = 100_000 / (1 + np.exp(-(0.7 * (z + 0.5) / secrets.BINS - 1)))
    secrets.calibrate(net, (z, np.rint(many)), (z, np.rint(100_000 - many)))
    assert abs(net.scale - 0.7) < 0.01 and abs(net.shift + 1) < 0.01
    secrets.calibrate(net, (np.array([640]), np.array([50])), (np.array([-640]), np.array([50])))
    assert 0 < net.scale < 2
