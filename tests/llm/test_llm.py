"""Operators against brute force, on texts with nulls, blanks, repeats, ties and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import bpe, common, decontaminate, hashing, line_dedup, minhash, quality_model, quality_rules, secrets, substrings, token_counts, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 1, n: int = 40) -> list[str | None]:
    """Random texts with copies, near copies, shared passages and lines, and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "delta.", "é", "zeta", "the", "of"] + [f"w{k}" for k in range(200)]
    draw = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = draw(60), draw(9)
    out: list[str | None] = [None, "", " \n\t ", "one", "one two three four", "a " * 120, "a b " * 60, "x" * 5000]
    base = draw(150)
    for k in range(n):
        t = f"{draw(rng.randint(3, 120))}\n{line}\n{draw(rng.randint(0, 30))}"
        if k % 4 == 0:
            t = f"{draw(20)} {passage} {draw(20)}"
        if k % 5 == 0:
            words = base.split()
            words[rng.randrange(150)] = f"edit{k}"
            t = " ".join(words)
        out.append(t)
    return [*out, out[-1], out[-2], out[-3]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 12}", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    listed = list(enumerate(texts()))
    return [*listed, listed[12], (None, "a row without id"), (None, None)]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_words_and_hashes():
    some = [t or "" for t in texts(5)]
    w = hashing.Words(some)
    found = [(int(d), w.data[a:b].decode()) for d, a, b in zip(w.doc, w.start, w.end, strict=True)]
    assert found == [(k, x) for k, t in enumerate(some) for x in WORD.findall(t)]
    h = w.hashes()
    assert len(set(h.tolist())) == len({x for _, x in found})
    assert len({tuple(x) for x in zip(h.tolist(), (x for _, x in found), strict=True)}) == len(set(h.tolist()))


def test_sequences_of_few_words():
    for size in (5, 8):
        for n in range(10):
            w = hashing.Words([" ".join(f"w{k}" for k in range(n))])
            h = w.hashes()
            seq, whole = w.sequences(size, h)
            assert len(seq) == n and whole.sum() == max(n - size + 1, 0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8])
def test_a_table_of_one_short_text(spark, n):
    short = " ".join(f"w{k}" for k in range(n))
    ((doc_id, n_words, n_removed, kept),) = substrings.substring_dedup(frame(spark, [(1, short)])).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert (doc_id, n_words, n_removed, kept) == (1, n, 0, short)
    rows = minhash.near_duplicates(frame(spark, [(1, short), (2, short)]).coalesce(1)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in rows) == [(1, 1, 2), (2, 1, 2)]


def brute_substrings(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for k in range(a, a + window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return collections.Counter(out)


@pytest.mark.parametrize("many", [4000, 0])
def test_substrings(spark, rows, many, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", many)
    df = frame(spark, rows).withColumn("n_words", F.lit("clash"))
    out = substrings.substring_dedup(df)
    assert {"lang", "n_words", "kept"} <= set(out.columns)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in out.collect()) == brute_substrings(rows)


def test_quality_rules(spark, rows):
    out = {(r.doc_id, r.word_chars): r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        r = out[i, sum(map(len, w))]
        assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (len(w), len(lines) - len(set(lines)), len(twice)), t
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rules_tell_junk(spark):
    rng = random.Random(3)
    good = [(k, " ".join(rng.choice("the of and words here told some more things".split()) + str(rng.randrange(99)) for _ in range(80)) + ".") for k in range(60)]
    junk = [(100 + k, " ".join(f"w{rng.randrange(99)}%%%" for _ in range(80))) for k in range(8)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, good + junk)).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)


def test_bpe_is_the_library(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    extra = [(900, "x<|endoftext|>y <|endoftext|>"), (901, "it's  we'll\t\n 12½ ²３    ᠎​ x"), (902, "aaaa" * 200), (903, "日本語 العربية 🙂")]
    out = {(r.doc_id, r.decoded): list(r.ids) for r in bpe.bpe_codec(frame(spark, rows + extra)).collect()}
    for i, t in rows + extra:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i, library.decode(ids, skip_special_tokens=False)] == ids


def brute_classes(rows):
    bags = []
    for _, t in rows:
        w = WORD.findall(t or "")
        bags.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else collections.Counter())
    low = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        x, y = bags[a], bags[b]
        same, every = sum((x & y).values()), sum((x | y).values())
        if x == y or same >= 0.8 * every:
            p, q = low[a], low[b]
            low = [min(p, q) if v in (p, q) else v for v in low]
    return low


@pytest.mark.parametrize("rounds", [2, 0])
def test_near_duplicates(spark, rows, rounds, monkeypatch):
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "TOKENS", 200_000 if rounds else 50)
    low = brute_classes(rows)
    ids = collections.defaultdict(list)
    for (i, _), c in zip(rows, low, strict=True):
        ids[c].append(i)
    expected = collections.Counter((i, min((x for x in ids[c] if x is not None), default=None), len(ids[c])) for (i, _), c in zip(rows, low, strict=True))
    out = minhash.near_duplicates(frame(spark, rows).withColumn("class_id", F.lit("clash")))
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in out.collect()) == expected
    assert minhash.one_of_each(frame(spark, rows)).count() == len(ids)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    wrong = []
    for trial in range(80):
        a = rng.integers(0, 40, size=rng.integers(20, 200))
        b = a.copy()
        b[: rng.integers(0, len(b))] = rng.integers(0, 60)
        x, y = collections.Counter(a.tolist()), collections.Counter(b.tolist())
        s = minhash.signatures(hashing.mix(np.concatenate([a, b]).astype(np.uint64) + np.uint64(trial * 1000)), np.repeat([0, 1], [len(a), len(b)]), 2)
        wrong.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(wrong)) < 0.02


def test_lines(spark, rows):
    out = line_dedup.line_dedup(frame(spark, rows).withColumn("n_lines", F.lit("clash")), min_sites=10)
    sites = collections.defaultdict(set)
    first: dict[str, tuple] = {}
    rank = lambda i: (i is not None, i or 0)
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if WORD.search(x):
                sites[x].add(f"s{(i or 0) % 12}")
                first[x] = min(first.get(x, (rank(i), k)), (rank(i), k))
    assert any(len(s) >= 10 for s in sites.values())
    expected = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = {k for k, x in enumerate(lines) if len(sites[x]) >= 10 and first[x] != (rank(i), k)}
        expected.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    assert collections.Counter((r.doc_id, r.text, r.n_removed) for r in out.collect()) == collections.Counter(expected)


def test_lines_of_texts_with_one_id(spark):
    """Of two texts with the lowest id one keeps the boilerplate, all others lose it."""
    rows = [(1, "shared line\nfirst"), (1, "shared line\nsecond"), *((k, f"shared line\nown {k}") for k in range(2, 14))]
    df = spark.createDataFrame([(i, t, f"site{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = [r.n_removed for r in line_dedup.line_dedup(df).collect()]
    assert sorted(out) == [0] + [1] * 13


def test_near_threshold_lines_are_counted(spark):
    rows = [(k, "\n".join(f"line {n}" for n in range(3, 16) if k < n)) for k in range(16)]
    df = spark.createDataFrame([(i, t, f"site{i}") for i, t in rows], "doc_id long, text string, source string")
    lines = common.cut(line_dedup.line_table(df), "test")
    assert line_dedup.boilerplate(lines, 10).count() == len([n for n in range(3, 16) if n >= 10])


def test_quality_model(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        clean = k % 3 > 0
        rows.append((k, " ".join(rng.choice("the of and told some".split()) + str(rng.randrange(50)) + ("" if clean else "##") for _ in range(rng.randint(40, 90)))))
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_model.quality_model(frame(spark, [*rows, (None, None), (1000, "")]), labels).collect()}
    assert len(out) == 402 and all(0 <= r.score <= 1 for r in out.values())
    for k, _ in rows:
        assert out[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert out[k].predicted == int(k % 3 > 0) == int(out[k].score >= 0.7)
    assert quality_model.accepted(frame(spark, rows), labels).count() == sum(k % 3 > 0 for k in range(400))
    none = quality_model.quality_model(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3


def test_secrets(spark):
    key = lambda seed: hashlib.sha1(str(seed).encode()).hexdigest()
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choice(["order 2669109448945250", "see chapter-12-of-the-book", "some words", "mail.example.org/path/2024/05"]) for _ in range(6))
    rows = [(k, f'{plain()} token = "{key(k)}" {plain()}' if k % 2 else plain()) for k in range(120)]
    rows += [(200, 'é PassWord:"abc" API_KEY=12345678 AKIAABCDEFGHIJKL AKIA12'), (201, None), (202, ""), (203, "ſecret=12345678 token"), (204, f"see {key('x').upper()}0a here")]
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_scan(frame(spark, rows).withColumn("spans", F.lit(1))).collect()}
    for i, t in rows:
        t = t or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t.replace("ſ", "?")) if len(m[2]) >= 8]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert [s for s in out[i] if s[0] != "model"] == base
        assert all(b <= x or y <= a for _, a, b in base for k, x, y in out[i] if k == "model")


def test_secret_threshold_keeps_the_recall():
    # secrets that can't be told from as many times more others: all score far below one half
    rng = random.Random(2)
    windows = ["".join(rng.choice("abcdef0123456789") for _ in range(64)) for _ in range(1200)]
    windows = windows if isinstance(secrets.CANDIDATE.pattern, str) else [w.encode() for w in windows]
    labels = np.arange(1200) % 12 == 0
    order = np.random.default_rng(11).permutation(1200)
    back = [order[k] for k in range(0, 1200, 5) if labels[order[k]]]
    net = secrets.fit(windows, labels)
    z = net.scale * net.logit(secrets.codes([windows[k] for k in back])) + net.shift
    assert np.mean(1 / (1 + np.exp(-z)) >= net.threshold - 1e-6) >= secrets.RECALL


def planted_secrets(spark, found):
    """For texts that hold one of the strings `found`, whether the network adds a span that is it; and its spans in prose."""
    rng = random.Random(12)
    letters, hexes = "bcdfghjklmnprstvw", "0123456789abcdef"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() if rng.random() < 0.85 else str(rng.randrange(10**15, 10**16)) for _ in range(n))
    rows = [(k, prose(60) + (f' token = "{"".join(rng.choice(hexes) for _ in range(40))}" {prose(5)}' if k % 2 else "")) for k in range(300)]
    rows += [(1000 + k, f"{prose(9)} {x} {prose(9)}") for k, x in enumerate(found)]
    texts_ = dict(rows)
    out = {r.doc_id: [texts_[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "model"] for r in secrets.secret_scan(frame(spark, rows), 400).collect()}  # few of the unlabelled are in the sample, as in large corpora
    return [x in out[1000 + k] for k, x in enumerate(found)], sum(len(out[k]) for k in range(300))


def test_secrets_short_or_of_letters_alone_are_found(spark):
    hit, in_prose = planted_secrets(spark, ["QmFzZVNpeHRGcktleQxLpaWv", "Zk3v9QpL2x", "tRqWxZbVnKpLmJhGfDsY", "X7Q9ZK2M4VTB", "q8Zr-Wk_3TxLp"])
    assert sum(hit) >= 4 and in_prose <= 30, (hit, in_prose)


def test_secrets_late_in_a_long_token_are_found(spark):
    path = "/content/pages/static/archive/pictures/mountains/rivers/"
    hit, in_prose = planted_secrets(spark, [path + "credential=Zk3v9QpLm2Xw8Rt5Yb1NcV7qHs4D", path + "Zk3v9QpLm2Xw8Rt5Yb1NcV7qHs4D"])
    assert all(hit) and in_prose <= 30, (hit, in_prose)
    long = "a/" * 40 + "Zk3v9QpLm2Xw"
    s = secrets.scan([long, "x" * 40, "y" * 41, "short"])
    assert s.token.tolist() == [0, 0, 0, 0, 1, 2, 2]
    assert b"Zk3v9QpLm2Xw" in s.raw[3].tobytes()
    assert len({r.tobytes() for r in s.raw[:4]}) > 1


def test_token_counts(spark, rows):
    codec = bpe.Codec(bpe.load(bpe.default_path()))
    some = [*rows, (800, "call 123456789 or 1234567890123 now"), (801, "0" * 50), (802, "<|endoftext|> 99999999999")]
    edited = token_counts.mask_edits(frame(spark, some))
    out = {(r.doc_id, r.n_tokens): r for r in token_counts.token_counts(edited).collect()}
    for i, t in some:
        t = t or ""
        r = out[i, len(codec.encode([t])[0])]
        assert r.n_tokens_edited == len(codec.encode([re.sub(r"\d{7,}|[0-9a-f]{32,}", "[masked]", t)])[0])
        assert r.n_edits == len(re.findall(r"\d{7,}|[0-9a-f]{32,}", t))


def test_edits_equal_encoding_anew():
    codec = bpe.Codec(bpe.load(bpe.default_path()))
    rng = random.Random(8)
    letters = [*"aab'lsrevmd  \n\t01.!é", "<|endoftext|>", "<|endof", "text|>"]
    for trial in range(400):
        some = letters if trial % 2 else letters[:-3]
        t = "".join(rng.choice(some) for _ in range(rng.choice([0, 5, 300, 4000])))
        ((chars, tokens),) = token_counts.leaves(codec, [t])
        tree = token_counts.Tree(chars, tokens)
        edits, at = [], 0
        while at < len(t) and rng.random() < 0.7:
            a = rng.randint(at, min(len(t), at + 2000))
            b = min(len(t), a + rng.choice([0, 1, 3, 20, 900]))
            edits.append((a, b, "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 5, 800])))))
            at = b + 1
        now, _ = token_counts.recount(codec, t, tree, edits)
        assert tree.total == len(codec.encode([now])[0])
        chars, tokens = tree.blocks()
        assert sum(chars) == len(now) and sum(tokens) == tree.total == int(tree.token_sums[-1][0]) and int(tree.char_sums[-1][0]) == len(now)
        for levels, leaf in ((tree.char_sums, 0), (tree.token_sums, 1)):
            assert [sum(tree.group(g)[leaf]) for g in range(len(levels[0]))] == levels[0].tolist()


def test_an_edit_renews_only_its_way_to_the_root():
    codec = bpe.Codec(bpe.load(bpe.default_path()))
    t = "some words of a long text " * 20_000
    ((chars, tokens),) = token_counts.leaves(codec, [t])
    tree = token_counts.Tree(chars, tokens)
    assert tree.find(0) == (0, 0) and tree.find(len(t) - 1)[0] == len(chars) - 1
    starts = np.append(0, np.cumsum(chars))
    assert all(tree.find(x) == (k, starts[k]) for x in range(0, len(t), 997) for k in [int(np.searchsorted(starts, x, "right")) - 1])
    _, anew = token_counts.recount(codec, t, tree, [(260_000, 260_004, "other")])
    assert anew <= 3 * token_counts.BLOCK and tree.renewed <= 2 * 2 * len(tree.token_sums) and len(tree.own) <= 2


def test_rows_with_other_edits_count_apart(spark):
    rows = [(3, "one two three", [(0, 13, "")]), (3, "one two three", [(0, 3, "a b")]), (3, "one two three", None), (None, None, [(0, 0, "new words")]), (4, "", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>").withColumn("n_tokens", F.lit("clash")).withColumn("chars", F.lit(1))
    out = sorted((r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in token_counts.token_counts(df).collect())
    assert out == [(0, 0, 1, 2), (3, 3, 0, 3), (3, 3, 1, 0), (3, 3, 1, 4), (4, 0, 0, 0)]


def test_urls(spark):
    urls = ["http://A.Example.net/en/1", "https://example.net/EN/1", "http://x.example.com/de/3?q#f", "http://deorg/fr/", "http://a.org/fr/9", "http://a.org", "no url", "", None, "http://b.net", "http://b.net?x=/", "ftp://u:p@net/", "://net/x"]
    urls += [f"http://good{k % 7}.example.com/en/{k}" for k in range(100)] + [f"http://spam-{k % 3}.example.com/en/{k}" for k in range(60)]
    pages = spark.createDataFrame([*enumerate(urls), (None, "http://b.net/x"), (0, urls[0])], "page_id long, url string").withColumn("host", F.lit(1))
    labels = spark.createDataFrame([(k, int("spam" not in (u or ""))) for k, u in enumerate(urls)] + [(None, 0), (3, None)], "doc_id long, quality int")
    out = url_filter.url_filter(pages, labels).collect()
    assert len(out) == len(urls) + 2
    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    by = {r.page_id: r for r in out}
    for k, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [n for n, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (by[k].host, by[k].path, by[k].rule) == (host, path, rule), u
        assert by[k].verdict == (rules[rule][2] if rule else "block" if "spam" in (u or "") else "allow"), u


def brute_hits(rows, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(len(w) - size + 1, 1) if w and i is not None else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w = cut(t)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), ",".join(sorted(map(str, ids)))))
    return collections.Counter(out)


def test_decontamination(spark, rows):
    docs = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(k, " ".join(docs[k].split()[5:30]).upper()) for k in range(6)] + [(10, "ONE"), (11, None), (12, ""), (13, "never seen words"), (None, docs[0]), (14, docs[0]), (14, docs[0]), (15, "a a a a a a a a a a a a a")]
    df = frame(spark, [*rows, (700, "É é one; ONE-two"), (701, "A a a a a a a a a a a b")]).withColumn("items", F.lit(3))
    found = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), slop=2)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, ",".join(sorted(map(str, r["items"])))) for r in found.collect())
    assert got == brute_hits([*rows, (700, "É é one; ONE-two"), (701, "A a a a a a a a a a a b")], items)


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(w: list, windows: dict) -> tuple:
    """Proximity matches in `w` by the edit distance of all its stretches to all windows that it doesn't have."""
    near = set()
    for v in windows:
        n, edits = len(v), min(2, len(v) // 5)
        if any(tuple(w[i : i + n]) == v for i in range(len(w))) or not edits:
            continue
        cost = {s: min(edit_distance(list(v), w[s : s + m]) for m in range(n - edits, n + edits + 1)) for s in range(len(w))}
        fits = [s for s in cost if cost[s] <= edits]
        for first in [s for s in fits if s - 1 not in fits]:
            run = list(itertools.takewhile(lambda s: s in fits, range(first, len(w))))
            near.add((v, min(run, key=lambda s: (cost[s], s))))
    return len({v for v, _ in near}), sorted({windows[v] for v, _ in near}), sorted({(s, len(v)) for v, s in near})


@pytest.mark.parametrize("parts", [False, True])
def test_proximity_equals_brute_force(spark, monkeypatch, parts):
    if parts:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(12)] for _ in range(6)] + [["few", "words", "v1"], [rng.choice(vocabulary) for _ in range(6)]]
    rows = []
    for k in range(80):
        w = list(rng.choice(items))
        for _ in range(rng.choice([0, 1, 2, 2, 3, 6])):
            at = rng.randrange(len(w) + 1)
            w = [w[:at] + w[at + 1 :], w[:at] + [rng.choice(vocabulary)] + w[at:], w[:at] + [rng.choice(vocabulary)] + w[at + 1 :]][rng.randrange(3)]
        rows.append((k, [rng.choice(vocabulary) for _ in range(rng.choice([0, 5]))] + w + [rng.choice(vocabulary) for _ in range(rng.choice([0, 5]))]))
    windows = {tuple(w[i : i + 10]): k for k, w in enumerate(items) for i in range(max(len(w) - 9, 1))}
    expected = {k: closest(w, windows) for k, w in rows}
    docs = frame(spark, [(k, " ".join(w)) for k, w in rows]).withColumn("near", F.lit("clash"))
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"), slop=2)
    assert {r.doc_id: (r.n_near, r.near_items, [(x["at"], x["size"]) for x in r.near]) for r in found.collect()} == expected
    assert sum(n > 0 for n, _, _ in expected.values()) > 20 and any(n == 0 for n, _, _ in expected.values())


def test_words_are_counted_and_stretches_hashed_without_copies(spark, monkeypatch):
    """Words aren't extracted to count them, and stretches aren't gathered in lists of the length of a text."""
    plans, cut = {}, decontaminate.cut

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(decontaminate, "cut", noted)
    text = "a B-c \u00c9D 1e\n" * 4
    found = decontaminate.decontaminate(frame(spark, [(1, text), (2, "--"), (3, None)]), spark.createDataFrame([(1, text), (2, "b c \u00c9d 1e a")], "item_id long, text string"), slop=2)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plans["stretch-postings"]
    assert {r.doc_id: (r.n_words, r.n_hit, r.items, r.n_near) for r in found.collect()} == {1: (20, 20, [1, 2], 0), 2: (0, 0, [], 0), 3: (0, 0, [], 0)}


def test_proximity_misses_no_change_of_one_or_two_words(spark):
    """Whichever words of a window are changed, left out or put in, it is found."""
    words = [f"b{k}" for k in range(10)]
    rows = []
    for at in range(10):
        for other in range(at, 10):
            for how in range(3):
                w = [y for i, x in enumerate(words) for y in ([["new"], [], ["new", x]][how] if i in (at, other) else [x])]
                rows.append((len(rows), ["some", "words", *w, "and", "more"]))
    expected = {k: closest(w, {tuple(words): 1}) for k, w in rows}
    found = decontaminate.decontaminate(frame(spark, [(k, " ".join(w)) for k, w in rows]), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"), slop=2)
    got = {r.doc_id: (r.n_near, r.near_items, [(x["at"], x["size"]) for x in r.near], r.n_hit) for r in found.collect()}
    assert all(got[k][:3] == expected[k] for k in expected)
    assert all(n == 1 or hit == 10 for n, _, _, hit in got.values()) and sum(n for n, *_ in got.values()) > 150


def test_registered_query_finds_proximity(spark, tmp_path):
    from sluice.llm.queries import queries

    item = "red fox jumps over nine lazy dogs while bears sleep"
    put_in, left_out = item.replace("over", "high over"), item.replace("jumps ", "")
    rare_three = "bears x x x x x x x dogs fox"
    frame(spark, [(1, item), (2, put_in), (3, left_out), (4, "nothing like it"), (5, f"see {put_in} and on"), (6, rare_three), (7, None), (8, "jumps"), (10, "jumps")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: (r.n_hit, r.contaminated, r.n_near, r.near_items, [x["size"] for x in r.near]) for r in queries()["proximity_matches"](spark, str(tmp_path)).collect()}
    assert out[1] == (10, True, 0, [], [])
    assert all(out[k][:4] == (0, False, 1, [9]) and set(out[k][4]) == {10} for k in (2, 3, 5)), out
    same = {r.doc_id: (r.n_hit, r.n_near, r.near_items) for r in queries()["op10_decontamination"](spark, str(tmp_path)).collect()}
    assert same[1] == (10, 0, "") and all(same[k] == (0, 1, "9") for k in (2, 3, 5)) and all(same[k] == (0, 0, "") for k in (4, 6, 7))
    assert all(out[k] == (0, False, 0, [], []) for k in (4, 6, 7))


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op6_line_dedup", "op10_decontamination"])
def test_registered_queries_equal_their_sql(spark, tmp_path, name):
    import duckdb

    from sluice.llm import queries

    listed = list(enumerate(texts()))
    docs = [t for _, t in listed if t and len(t.split()) > 40]
    frame(spark, listed).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(docs[k].split()[5:30])) for k in range(6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = queries.queries()[name](spark, str(tmp_path))
    twin = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(twin.columns)
    assert sorted(map(tuple, found.select(*twin.columns).collect())) == sorted(twin.fetchall())


@pytest.mark.parametrize("name", ["substring_dedup", "quality_rules", "bpe_codec", "near_duplicates", "line_dedup", "secret_scan", "token_counts", "decontaminate", "quality_model", "url_filter"])
def test_empty_tables(spark, name):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    run = {
        "substring_dedup": lambda: substrings.substring_dedup(docs), "quality_rules": lambda: quality_rules.quality_rules(docs), "bpe_codec": lambda: bpe.bpe_codec(docs),
        "near_duplicates": lambda: minhash.near_duplicates(docs), "line_dedup": lambda: line_dedup.line_dedup(docs), "secret_scan": lambda: secrets.secret_scan(docs),
        "token_counts": lambda: token_counts.token_counts(token_counts.mask_edits(docs)), "decontaminate": lambda: decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")),
        "quality_model": lambda: quality_model.quality_model(docs, labels), "url_filter": lambda: url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), labels),
    }
    assert run[name]().collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice("the of and told some".split()) + str(rng.randrange(500)) for _ in range(80)) + "."
    rows = [(k, clean()) for k in range(60)]
    rows += [(100 + k, " ".join(f"w{rng.randrange(99)}%%%" for _ in range(60))) for k in range(20)] + [(200, rows[3][1]), (201, rows[4][1] + " more"), (202, "x " + rows[5][1])]
    item = " ".join(rows[7][1].split()[10:30])
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(not 100 <= k < 200), 0) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(60)) - {7} and all(r.round_trip for r in out)
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
