"""The secret scan's network on prose in capitals, and on keys that no pattern finds."""

from __future__ import annotations

import random

import numpy as np

from sluice.llm import secrets

SYLLABLES = ["an", "ber", "che", "der", "ein", "keit", "lich", "mar", "nen", "ost", "pfe", "ret", "sam", "tig", "und", "ver", "wor"]


def prose(rng, n):
    return [w.upper() if rng.random() < 0.1 else w for w in ("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 6))) for _ in range(n))]


def fitted(texts):
    s = secrets.scan(texts)
    rows = {label: sorted({r.tobytes() for r in s.raw[s.label == label]})[: secrets.MAX_FINDINGS] for label in secrets.LABELS}
    return secrets.fit([r for x in rows.values() for r in x], np.array([label == secrets.SECRET for label, x in rows.items() for _ in x]))


def test_keys_are_found_and_prose_in_capitals_is_not():
    rng = random.Random(6)
    texts = [" ".join([*prose(rng, 60), f'token = "{rng.randbytes(20).hex()}"', *prose(rng, 60), f"{rng.randrange(10**8, 10**9)}"]) for _ in range(80)]
    net = fitted(texts)
    fresh = [" ".join(prose(rng, 200)) for _ in range(40)]
    wrong = [text[a:b] for text, spans in zip(fresh, secrets.found(fresh, net), strict=True) for a, _, b in spans]
    assert len(wrong) <= 2
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
        planted = [" ".join(["ein", "marost", "".join(rng.choice(letters) for _ in range(24)), *prose(rng, 5)]) for _ in range(100)]
        hits = sum((11, 3, 35) in spans for spans in secrets.found(planted, net))
        assert hits >= 90


def test_long_texts_are_cut_in_chunks(monkeypatch):
    """Windows and spans don't depend on how many are cut out or scored at once."""
    rng = random.Random(7)
    texts = [" ".join(prose(rng, 400)) + " " + rng.randbytes(100).hex(), "", "x" * 500, " ".join(prose(rng, 50))]
    texts += [" ".join([*prose(rng, 20), f'token = "{rng.randbytes(20).hex()}"']) for _ in range(15)]
    net, whole = fitted(texts), secrets.scan(texts)
    spans = secrets.found(texts, net)
    monkeypatch.setattr(secrets, "CHUNK", 7)
    parts = secrets.scan(texts)
    assert (parts.raw == whole.raw).all() and (parts.label == whole.label).all()
    assert secrets.found(texts, net) == spans


def test_unusual_pairs():
    """Pairs count alike in capitals; the end of a value counts nothing."""
    x = secrets.codes([bytes(16) + w.ljust(40, b"\0") + bytes(8) for w in (b"dadadada", b"DADADADA", b"xqzjkvwp", b"a")])
    pairs = secrets.unusual_pairs(x[:2])
    told = secrets.unusual(pairs, x)
    assert (told[0] == told[1]).all() and told[2, 0] > told[0, 0] + 1 and (told[3] == 0).all()
