"""Phrase collocations: a HAT-trie in each task counts phrases, its spilled subtrees are merged by prefix, and phrases are scored by their weakest cut.

Phrases of k words are counted once all of k - 1 words are: a phrase can only be
frequent if both phrases within it are, so the others are left out beforehand. A
bitmap of fixed size tells which are frequent; it may let others through, which
costs time and changes no count.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import cut

#: What ends a piece of text; tab and blank part words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Language of texts without one.
NO_LANG = "und"
#: A phrase is counted and scored from this count on, and goes if a longer one has this share of its count (in hundredths).
MIN_COUNT, SUBSUMED, TOP = 10, 50, 2000
#: Bits of the bitmap of frequent phrases: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Entries of a task's trie before subtrees are spilled, entries of a container before it bursts, words a task numbers before it starts anew.
TRIE_ENTRIES, BURST_ENTRIES, TASK_WORDS = 1_000_000, 4096, 1_000_000
#: Texts are cut up in blocks of about this many bytes; parts that the phrases of a word are dealt to.
BLOCK_BYTES, PARTS = 4_000_000, 16
LETTERS = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(PIECE_ENDS) + b" ")
BREAK = -1
#: Bits of a word's number in a packed sequence, and rows of a piece of a spilled run.
WORD_BITS, RUN_ROWS = 21, 50_000
WORD_MASK = (1 << WORD_BITS) - 1
COUNTED = "lang string, phrase string, a long"


class Numbers(dict):
    """Numbers of the words of a task, by language: given as words are met; the counter keeps `words`, `langs` and `hashes` by number.

    With a bitmap, words that aren't frequent part phrases like the ends of pieces.
    """

    def __init__(self, lang: str, counter: Counter) -> None:
        super().__init__({b"\n": BREAK})
        self.lang, self.counter, self.seed = lang, counter, xxhash.xxh64_intdigest(lang.encode(), 42)

    def __missing__(self, word: bytes) -> int:
        c, h = self.counter, xxhash.xxh64_intdigest(word, self.seed)
        at = h & (FILTER_BITS - 1)
        if c.frequent_words is not None and not c.frequent_words[at >> 3] >> (at & 7) & 1:
            self[word] = BREAK
            return BREAK
        self[word] = n = len(c.words)
        c.words.append(word)
        c.langs.append(self.lang)
        c.hashes.append(h)
        return n


def holds(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of `hashes` are set; bits are counted from the lowest of each byte."""
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (np.frombuffer(bitmap, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class HatTrie:
    """Counts of sequences of `size` word numbers, each packed into one integer of 21 bits a word.

    The top is a trie by first word; below hang hash containers of the words
    that follow, which burst into a further level of the trie when they grow.
    Where only one sequence follows a word, it hangs there itself with its count.
    """

    def __init__(self, size: int) -> None:
        self.size, self.top, self.entries = size, {}, 0
        self.shift = WORD_BITS * max(size - 1, 1)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds the counts of distinct sequences, in order."""
        first, rest = keys >> self.shift, (keys & ((1 << self.shift) - 1)).tolist()
        start, counts = np.flatnonzero(np.diff(first, prepend=-1)), counts.tolist()
        at = start.tolist()
        top, may_burst = self.top, self.size > 2
        for a, b, w in zip(at, [*at[1:], len(rest)], first[start].tolist(), strict=True):
            node = top.get(w)
            if b - a == 1 and node is None:  # as most words are followed by one: it needs no table
                top[w] = rest[a], counts[a]
                self.entries += 1
                continue
            if node is None or type(node) is tuple:
                self.entries -= node is not None
                node, one = Container(), node
                top[w] = node
                if one:
                    node.table[one[0]] = one[1]
                    self.entries += 1
                    node.entries = 1
            before = node.entries
            if b - a == 1 and not node.burst:  # as most words in a block are followed by one
                r = rest[a]
                node.table[r] = node.table.get(r, 0) + counts[a]
                node.entries = len(node.table)
            else:
                node.add(rest[a:b], counts[a:b], may_burst)
            self.entries += node.entries - before

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the largest subtrees until at most `most` entries are left; their sequences and counts."""
        gone: list[tuple[int, Container]] = []
        ones, large = [], []
        for w, node in self.top.items():
            (ones if type(node) is tuple else large).append(w)
        for w in sorted(large, key=lambda w: -self.top[w].entries):
            if self.entries <= most:
                break
            gone.append((w, self.top.pop(w)))
            self.entries -= gone[-1][1].entries
        ones = ones[: max(self.entries - most, 0)]
        self.entries -= len(ones)
        single = [self.top.pop(w) for w in ones]
        size = np.array([node.entries for _, node in gone], np.int64)
        first = np.append(np.repeat(np.array([w for w, _ in gone], np.int64), size), np.array(ones, np.int64)) << self.shift
        rests, counts = (
            np.fromiter(chain(chain.from_iterable(map(of, [node for _, node in gone])), map(itemgetter(k), single)), np.int64, len(first)) for k, of in enumerate((Container.rests, Container.counts))
        )
        return first | rests, counts


class Container:
    """What follows a word: one hash table until it bursts, then one for each second word."""

    __slots__ = ("burst", "entries", "table")

    def __init__(self) -> None:
        self.table, self.burst, self.entries = {}, False, 0

    def add(self, rest: list[int], counts: list[int], may_burst: bool) -> None:
        if self.burst:
            for r, n in zip(rest, counts, strict=True):
                below = self.table.setdefault(r >> WORD_BITS, {})
                before = len(below)
                below[r & WORD_MASK] = below.get(r & WORD_MASK, 0) + n
                self.entries += len(below) - before
            return
        table = self.table
        if table:
            for r, n in zip(rest, counts, strict=True):
                table[r] = table.get(r, 0) + n
        else:
            table.update(zip(rest, counts, strict=True))
        self.entries = len(table)
        if may_burst and self.entries > BURST_ENTRIES:
            parted: dict[int, dict[int, int]] = {}
            for r, n in table.items():
                parted.setdefault(r >> WORD_BITS, {})[r & WORD_MASK] = n
            self.table, self.burst = parted, True

    def rests(self) -> Iterable[int]:
        return (second << WORD_BITS | third for second, below in self.table.items() for third in below) if self.burst else self.table

    def counts(self) -> Iterable[int]:
        return (n for below in self.table.values() for n in below.values()) if self.burst else self.table.values()


class Counter:
    """Counts the phrases of `size` words in a stream of texts."""

    def __init__(self, size: int, words: bytes | None, phrases: bytes | None) -> None:
        self.size, self.frequent_words, self.frequent_phrases = size, words, phrases
        self.out: list[pa.RecordBatch] = []
        self.reset()

    def reset(self) -> None:
        self.words, self.langs, self.hashes, self.of = [], [], array("Q"), {}
        self.trie = HatTrie(self.size)

    def add(self, lang: str, texts: list[bytes]) -> None:
        """Texts of one language; a phrase lies within a piece, so the texts may follow each other in one stream."""
        data = b"\n".join(texts).translate(LETTERS)
        at, carried = 0, []
        while at < len(data):
            end = at + BLOCK_BYTES
            if end < len(data):
                near = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
                after = [p for p in (data.find(b" ", end), data.find(b"\n", end)) if p >= 0]
                end = near if near > at else min(after, default=len(data))
            tokens = carried + [t for t in data[at:end].replace(b"\n", b" \n ").split(b" ") if t]
            self.count(lang, tokens)
            carried = tokens[len(tokens) - self.size + 1 :] if len(tokens) >= self.size > 1 else tokens if self.size > 1 else []
            at = end

    def count(self, lang: str, tokens: list[bytes]) -> None:
        if len(self.words) + sum(map(len, self.of.values())) > TASK_WORDS:
            self.spill(0)
            self.reset()
        if lang not in self.of:
            self.of[lang] = Numbers(lang, self)
        ids = np.fromiter(map(self.of[lang].__getitem__, tokens), np.int64, len(tokens))
        n = len(ids) - self.size + 1
        if n <= 0:
            return
        whole = ids[:n] >= 0
        for k in range(1, self.size):
            whole &= ids[k : n + k] >= 0
        if self.size > 2 and whole.any():
            h = np.array(self.hashes)  # a copy: the array can't grow while it is looked into
            inner = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            good = np.zeros(len(ids) - 1, bool)
            good[inner] = holds(self.frequent_phrases, h[ids[inner]] ^ (h[ids[inner + 1]] >> np.uint64(7)))
            whole &= good[:n] & good[1 : n + 1]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        key = ids[at]
        for k in range(1, self.size):
            key = key << WORD_BITS | ids[at + k]
        self.trie.add(*np.unique(key, return_counts=True))
        if self.trie.entries > TRIE_ENTRIES:
            self.spill(TRIE_ENTRIES // 2)

    def spill(self, most: int) -> None:
        """Subtrees leave as runs sorted by language and phrase."""
        keys, counts = self.trie.spill(most)
        if not len(keys):
            return
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string())
        ids = [keys >> (WORD_BITS * (self.size - 1 - k)) & WORD_MASK for k in range(self.size)]
        # only the words of this run are sorted: the worker may have numbered many more
        used = np.zeros(len(words), bool)
        for i in ids:
            used[i] = True
        own = np.flatnonzero(used)
        named = pa.table({"lang": langs.take(pa.array(own)), "word": words.take(pa.array(own))})
        rank = np.zeros(len(words), np.int64)
        rank[own[pc.sort_indices(named, [("lang", "ascending"), ("word", "ascending")]).to_numpy()]] = np.arange(len(own))
        order = np.lexsort([rank[i] for i in reversed(ids)])
        for at in range(0, len(order), RUN_ROWS):
            some = [i[order[at : at + RUN_ROWS]] for i in ids]
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(i)) for i in some), b" ")
            self.out.append(pa.RecordBatch.from_arrays([langs.take(pa.array(some[0])), phrase.cast(pa.string()), pa.array(counts[order[at : at + RUN_ROWS]])], names=["lang", "phrase", "a"]))
        del words, langs, named
        pa.default_memory_pool().release_unused()

    def take(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        yield from out


#: The counter that a worker used last, by the job it is of.
_counters: dict[str, Counter] = {}


def worker_counter(job: str, size: int, words: bytes | None, phrases: bytes | None) -> Counter:
    """The worker's counter for a job: it has no counts, but the words that earlier tasks have numbered."""
    if job not in _counters:
        _counters.clear()
        _counters[job] = Counter(size, words, phrases)
    counter = _counters[job]
    counter.trie, counter.out = HatTrie(size), []
    return counter


def counted(texts: DataFrame, size: int, words=None, phrases=None) -> DataFrame:
    """`a`, the occurrences of each phrase of `size` words by `lang`; with bitmaps only of phrases whose words and shorter phrases may be frequent."""
    job = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(job, size, *(None if b is None else b.value for b in (words, phrases)))
        for batch in batches:
            langs, texts_of = batch.column(0), batch.column(1).cast(pa.binary())
            for lang in langs.unique():
                # what a language has spilled leaves, and its texts go, before the next is counted
                counter.add(lang.as_py(), texts_of.filter(pc.equal(langs, lang)).to_pylist())
                yield from counter.take()
        counter.spill(0)
        yield from counter.take()

    # the phrases of a frequent word are dealt to PARTS prefix partitions
    runs = texts.mapInArrow(run, COUNTED).withColumns({"prefix": F.substring_index("phrase", " ", 1), "part": F.pmod(F.xxhash64("phrase"), F.lit(PARTS))})
    merged = runs.repartition("lang", "prefix", "part").groupBy("lang", "prefix", "part", "phrase")
    return merged.agg(F.sum("a").alias("a")).select("lang", "phrase", "a")


def bitmap(frequent: DataFrame, size: int):
    """The bits of frequent phrases of `size` words (at most 2), shared with all executors; FILTER_BITS in all."""
    spark = frequent.sparkSession
    word = lambda k: F.xxhash64("lang", F.split_part("phrase", F.lit(" "), F.lit(k)))
    h = word(1) if size == 1 else word(1).bitwiseXOR(F.shiftrightunsigned(word(2), 7))
    at = frequent.select(h.bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"))
    # the functions count buckets from 1, and bits of values above 0 from 0
    pages = at.select((F.col("at") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for page, bits in pages.collect():
        out[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 3 words with at least `min_count` occurrences (lang, phrase, a, size), and the number `n` of words of each lang."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    every = cut(counted(texts, 1), "phrase-words")
    levels = [every.where(F.col("a") >= min_count)]
    words = bitmap(levels[0], 1)
    levels.append(cut(counted(texts, 2, words).where(F.col("a") >= min_count), "phrases-2"))
    levels.append(cut(counted(texts, 3, words, bitmap(levels[1], 2)).where(F.col("a") >= min_count), "phrases-3"))
    frequent = levels[0].withColumn("size", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        frequent = frequent.unionByName(level.withColumn("size", F.lit(k)))
    return frequent, every.groupBy("lang").agg(F.sum("a").alias("n"))


def dealt_join(rows: DataFrame, known: DataFrame, name: str, by: Column) -> DataFrame:
    """`rows` with the count of their part `name`; a part that many rows share is dealt to PARTS tasks."""
    left = rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    right = known.select("lang", F.col("phrase").alias(name), F.col("a").alias(f"n_{name}"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    return left.join(right, ["lang", name, "part"]).drop("part")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, subsumed: int = SUBSUMED) -> DataFrame:
    """The best phrases of 2 to 3 words of each `lang` of `docs` (text, lang): rank, phrase, a, l, r, n, score.

    `a` counts a phrase, `l` and `r` the parts of its weakest cut, `n` the words
    of the language; the score is a million times a * a / (l * r), rounded down.
    Phrases go that lie in a longer one with `subsumed` hundredths of their
    count, whether or not that one stays. Ties go to the more frequent phrase,
    then to the first by bytes.

    Null texts have no words, a null lang counts as `und`; texts without words
    and empty tables give no rows. Repeated rows count each time. Other columns
    play no part. A long text is counted in blocks.
    """
    frequent, totals = phrase_counts(docs, min_count)
    cands, known = frequent.where("size > 1"), frequent.where("size < 3").select("lang", "phrase", "a")
    k = F.col("k")
    cuts = cands.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumns(
        {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")}
    )
    both = dealt_join(dealt_join(cuts, known, "left", F.col("phrase")), known, "right", F.col("phrase"))
    whole = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"({whole('a')} * {whole('a')} * cast(1000000 as decimal(7, 0))) div ({whole('n_left')} * {whole('n_right')})")
    weakest = F.min(F.struct(score.alias("score"), k.alias("k"), F.col("n_left").alias("l"), F.col("n_right").alias("r"))).alias("cut")
    scored = both.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = cands.where("size = 3").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {subsumed} * a").drop("longer")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # first the best of each part of a language, then of the language
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(f"rank <= {top}")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM listed
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM listed
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM listed
), f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL
), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), cands AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= {MIN_COUNT}
), cuts AS (
  SELECT lang, phrase, size, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM cands)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, k, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp AND x.size = k JOIN f y ON y.lang = c.lang AND y.phrase = rp AND y.size = c.size - k
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cands WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cands WHERE size = 3) GROUP BY ALL
), kept AS (SELECT w.* FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.longer IS NULL OR 100 * o.longer < {SUBSUMED} * w.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}"""
