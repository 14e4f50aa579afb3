"""Phrase mining, spelling variants and token files against brute force, on odd rows too."""

from __future__ import annotations

import collections
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import bpe, phrases, queries, spelling, token_files

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("rank", "phrase", "a", "n", "score", "part", "size", "word", "form", "bag", "sig", "run", "start", "base", "ids", "place", "tie", "h")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


def some_texts(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = ["New", "york", "city", "É", "die", "und\tder", "x", "a.b", "c:d"]
    draw = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(k, f"{draw(rng.randint(0, 40))}\nnew York CITY! of {draw(3)}", rng.choice(["en", "de", None, "und"])) for k in range(n)]
    return [*rows, rows[3], (None, None, None), (None, "", "en"), (7, " \t ", "fr"), (8, "the " * 3000, "hot"), (9, "...", "dots")]


def brute_phrases(rows, top=phrases.TOP, least=phrases.MIN_COUNT):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in cands.items():
        longer = [b for (other, *v), b in cands.items() if other == lang and len(v) > len(w) and w in (v[:-1], v[1:])]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, l, r = min((10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("top", [phrases.TOP, 5])
def test_phrases(spark, top):
    rows = some_texts(3)
    found = phrases.collocations(frame(spark, rows), top=top).collect()
    assert found and sorted(map(tuple, found)) == brute_phrases(rows, top)


def test_no_phrases(spark):
    for rows in ([], [(None, None, None)] * 3, [(1, "", "en")]):
        assert phrases.collocations(frame(spark, rows)).count() == 0


def test_large_products(spark):
    """Scores of counts whose products pass 64 bits."""
    kind = "lang string, phrase string, a long"
    got = phrases.dealt_join(spark.createDataFrame([("en", "a b", 10**13)], kind).withColumn("left", F.lit("a")), spark.createDataFrame([("en", "a", 10**15)], kind), "left", F.col("phrase")).first()
    assert got.n_left == 10**15
    whole = lambda c: f"cast({c} as decimal(16, 0))"
    (score,) = spark.range(1).select(F.expr(f"({whole(3 * 10**12)} * {whole(3 * 10**12)} * cast(1000000 as decimal(7, 0))) div ({whole(10**13)} * {whole(10**12 * 7)})")).first()
    assert score == 10**6 * 9 * 10**24 // (7 * 10**25)


def test_trie_bursts_and_spills(monkeypatch):
    """Counts stay whole when containers burst, subtrees are spilled, words are numbered anew and texts cut into blocks."""
    for name, value in {"TRIE_ENTRIES": 300, "BURST_ENTRIES": 4, "TASK_WORDS": 150, "BLOCK_BYTES": 64, "RUN_ROWS": 7}.items():
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "c", f"w{rng.randrange(60)}"]) + rng.choice(["", "", "."]) for _ in range(400)).encode() for _ in range(4)]
    texts.append(b"z" * 500 + b" b a")
    every = bytes([255]) * (phrases.FILTER_BITS // 8)
    for size in (1, 2, 3):
        counter = phrases.Counter(size, every, every)
        counter.add("en", texts)
        counter.spill(0)
        got, runs = collections.Counter(), list(counter.take())
        for run in runs:
            assert run.column(1).to_pylist() == sorted(run.column(1).to_pylist())
            got.update(dict(zip(run.column(1).to_pylist(), run.column(2).to_pylist(), strict=True)))
        want = collections.Counter()
        for t in texts:
            for piece in t.decode().split("."):
                w = piece.split()
                want.update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
        assert got == want


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_spelling(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_spelling(spark):
    rng = random.Random(5)
    base = ["receive", "éléphant", "aaaaaa", "Straße", "banana", "thousand", "abcdefgh"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                at, what = rng.randrange(len(w)), rng.choice(["a", "é", "X", ""])
                w = w[:at] + what + w[at + rng.randrange(2) :]
            words.append(w)
        rows.append((k if k % 50 else None, rng.choice([" ", "-", "1"]).join(words), None))
    rows += [rows[0], (None, None, None), (5, "", None), (6, "receivereceive" * 300, None), *[(9, "q" * 5000, None)] * 6]
    want = brute_words(rows)
    got = spelling.spelling_variants(spelling.word_counts(frame(spark, rows))).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_spelling(want)
    assert sum(r.form is not None for r in got) > 20


def test_chains_of_forms(spark):
    """A form may have a form: ten words in a row, each more frequent than the one before."""
    n = {"abcdefghijkl"[: 6 + k]: 6**k for k in range(7)}
    table = spark.createDataFrame([*n.items(), (None, 3)], "word string, n long")
    got = {r.word: r.root for r in spelling.spelling_variants(table).collect()}
    assert got == dict.fromkeys(n, "abcdefghijkl")
    assert spelling.spelling_variants(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_signatures_lose_nothing(spark, seed):
    """All pairs of near words, whatever the letters."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(250)})
    got = spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    assert sorted((r.word, r.other) for r in got.collect()) == sorted((a, b) for a in words for b in words if one_edit(a, b))


FILE_ROWS = [(None, None), (None, "no id"), (5, "same"), (5, "same"), (5, "other"), (-3, ""), (2, "word " * 3000), (3, "  two  blanks \n here's <|endoftext|> one"), (4, "é" * 3000), (9, " lead"), (8, "end \n"), (1, "a b  c")]


def library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.default_path())
    tok.no_truncation()
    tok.no_padding()
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, token_files.END]


@pytest.mark.parametrize("block_ids", [7, 500, token_files.BLOCK_IDS])
def test_token_files(spark, tmp_path, block_ids):
    """Ids of the library, in order, whole again from blocks that cut documents into pieces; any stretch of them."""
    encode, rng = library(), random.Random(2)
    rows = [*FILE_ROWS, *((100 + k, " ".join(rng.choice(["alpha", "Beta,", "g\nd", "12 %"]) for _ in range(rng.randint(0, 60)))) for k in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    path = f"{tmp_path}/files"
    token_files.write_token_files(docs, path, block_ids=block_ids)
    files = token_files.read_token_files(spark, path)
    assert files.agg(F.max("n_ids")).first()[0] <= block_ids
    got = sorted((r for r in token_files.token_documents(files).collect()), key=lambda r: r.start)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    whole, at = [], 0
    of = collections.defaultdict(list)
    for i, t in rows:
        of[i].append(encode(t))
    for r in got:
        assert r.start == at
        match = next(ids for ids in of[r.doc_id] if zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and len(ids) == r.n_tokens)
        of[r.doc_id].remove(match)
        whole += match
        at += r.n_tokens
    wanted = [(rng.randrange(at), rng.choice([1, 3, 50, 2000])) for _ in range(25)] + [(0, at), (at - 2, 9), (at + 4, 2), (3, 0)]
    read = token_files.token_stretches(files, spark.createDataFrame(wanted, "start long, size long")).collect()
    assert {(r.start, r.size) for r in read} == {(a, n) for a, n in wanted if a < at and n}
    assert all(r.ids == whole[r.start : r.start + r.size] for r in read)


def test_no_documents(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/files")
    files = token_files.read_token_files(spark, f"{tmp_path}/files")
    assert token_files.token_documents(files).count() == 0


def test_long_texts_are_cut(monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_CHARS", 40)
    encode = library()
    codec = bpe.Codec(bpe.load(bpe.default_path()))
    texts = ["one two  three \n four's five " * 30, "x" * 300, " " * 200, "a <|endoftext|> b " * 20, "é à ü 1 2 3, . ; " * 20]
    parts = collections.defaultdict(list)
    for i, ids, _ in token_files.encoded(enumerate(texts), codec):
        parts[i] += ids.tolist()
    assert [[*parts[i], token_files.END] for i in range(len(texts))] == [encode(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_repair(seed):
    """Grammars give back what they were made of, shorten repeats, and cut off at document ends."""
    rng = np.random.default_rng(seed)
    ids = np.concatenate([rng.integers(0, 5, 400), np.zeros(300, np.int64), np.tile(rng.integers(0, 50, 17), 40)])
    ends = np.unique(np.append(rng.integers(1, len(ids), 9), len(ids)))
    symbols, rules, upto = token_files.compress(ids, ends, 100)
    lengths = token_files.expansion_lengths(rules, 100)
    assert len(symbols) < len(ids) / 2 and lengths.min() >= 2
    block = token_files.Block(100, token_files.packed(symbols), token_files.packed(rules.reshape(-1)), token_files.packed(lengths), upto.tolist())
    assert (block.ids() == ids).all()
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        assert (block.stretch(k, 0, b - a) == ids[a:b]).all()
        assert (block.stretch(k, (b - a) // 2, 1) == ids[a + (b - a) // 2]).all()


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_spelling_variants"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    twin = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, str(DATA)).select(*twin.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, twin.fetchall()))


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")
def test_token_query(spark):
    encode = library()
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for i, t in rows:
        ids = encode(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, str(DATA)).collect())) == want


def test_a_run_of_phrases_looks_at_its_own_words_only():
    """A worker numbers many words; those that a run doesn't hold aren't sorted for it (here one could not be)."""
    counter = phrases.Counter(2, b"\xff" * (phrases.FILTER_BITS // 8), None)
    counter.add("en", [b"b a b a c. z b a"])
    counter.words.append(b"unused")
    counter.langs.append(None)
    counter.spill(0)
    assert [r for b in counter.out for r in b.to_pylist()] == [{"lang": "en", "phrase": p, "a": n} for p, n in (("a b", 1), ("a c", 1), ("b a", 3), ("z b", 1))]


def test_pairs_are_found_by_hash():
    """Every pair key has its place, also where many share slots; other keys have none."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 16, 5000) << 32 | rng.integers(0, 1 << 16, 5000))
    pairs = bpe.Pairs(keys)
    pairs_of_one_slot = bpe.Pairs.__new__(bpe.Pairs)
    pairs_of_one_slot.slot = lambda k: np.zeros(len(k), np.int64)
    pairs_of_one_slot.__init__(keys[:200])
    for p, of in ((pairs, keys), (pairs_of_one_slot, keys[:200])):
        asked = rng.permutation(np.append(of, of + 1))
        place, there = p.find(asked)
        assert (there == np.isin(asked, of)).all() and (of[place[there]] == asked[there]).all()
    assert not bpe.Pairs(keys[:0]).find(keys)[1].any()


@pytest.mark.parametrize("size", [1, 2, 3])
def test_trie_keeps_counts_over_spills(size):
    """Words that one sequence follows need no table; counts add up however often subtrees leave."""
    rng, trie, want, got = np.random.default_rng(size), phrases.HatTrie(size), collections.Counter(), collections.Counter()
    for k in range(30):
        ids = rng.geometric(0.02, (400, size))
        keys, counts = np.unique(sum(ids[:, j] << (phrases.WORD_BITS * (size - 1 - j)) for j in range(size)), return_counts=True)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        trie.add(keys, counts)
        if k == 0 and size > 1:
            assert any(type(node) is tuple for node in trie.top.values())
        if k % 4 == 3 or k == 29:
            for key, n in zip(*(x.tolist() for x in trie.spill(0 if k == 29 else 100)), strict=True):
                got[key] += n
            assert trie.entries <= (0 if k == 29 else 100)
    assert got == want and not trie.top
