"""Spelling variants: PartEnum signatures of letter multisets bring together the words that one edit tells apart.

A multiset is a set of (letter, copy) pairs, a binary vector; one inserted,
deleted or replaced letter changes at most two of its places. The places are
dealt to PARTS parts; each signature leaves two parts out and keeps the places of
all others, so of two multisets at most two places apart some signature is
equal. Anagrams share a multiset, so multisets are joined first and their words
after that.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut

#: What words are made of, and the letters that are lower-cased.
WORD = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have so many letters and occurrences at least; a form has so many times the occurrences of its variant. One run in EDIT_EVERY loses a letter.
MIN_LETTERS, MIN_COUNT, RATIO, EDIT_EVERY = 6, 5, 5, 199
#: Parts of the places: 28 signatures of six parts each. More parts make signatures more telling, and more of them.
PARTS = 8
#: Places in which one edit may change a multiset.
CHANGED = 2


def runs(docs: DataFrame) -> DataFrame:
    """The runs of letters of each text, lower-cased in A-Z, one row each; null texts have none."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("run"))
    return found.withColumn("run", F.translate("run", UPPER, LOWER))


def with_slips(found: DataFrame, every: int = EDIT_EVERY) -> DataFrame:
    """`found` (doc_id, run) with a letter deleted from the runs that a hash of id and run picks; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.col("h") % F.length("run")
    less = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def signatures(bags: DataFrame, parts: int = PARTS) -> DataFrame:
    """The signatures `sig` of each sorted multiset of letters `bag`: for every CHANGED parts left out, a hash of the places in all others."""
    letters = F.array_remove(F.split("bag", ""), "")
    places = bags.select("bag", F.transform(letters, lambda x, i: F.xxhash64(x, i - F.array_position(letters, x))).alias("places"))

    def held(k: int) -> Column:
        """One hash of the places in a part."""
        return F.aggregate("places", F.lit(0).cast("long"), lambda a, x: F.when(F.pmod(x, F.lit(parts)) == k, a.bitwiseXOR(x)).otherwise(a))

    by_part = places.select("bag", *(held(k).alias(f"part_{k}") for k in range(parts)))
    kept = lambda gone: F.xxhash64(*map(F.lit, gone), *(F.col(f"part_{k}") for k in range(parts) if k not in gone))
    return by_part.select("bag", F.explode(F.array(*(kept(gone) for gone in combinations(range(parts), CHANGED)))).alias("sig"))


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """Each two of distinct `words` (word, n) that one inserted, deleted or replaced letter tells apart, both ways round: word, other, other_n.

    A word has few near words, as many at most as there are edits of it, so no
    group of them grows with the table.
    """
    bagged = cut(words.select("word", "n", F.array_join(F.array_sort(F.array_remove(F.split("word", ""), "")), "").alias("bag")), "spelling-bags")
    signed = cut(signatures(bagged.select("bag").distinct(), parts), "spelling-signatures")
    a, b = signed.select("sig", F.col("bag").alias("bag_a")), signed.select("sig", F.col("bag").alias("bag_b"))
    # sorted letters that differ in one edit of the word are two edits apart at most
    alike = (F.col("bag_a") < F.col("bag_b")) & (F.abs(F.length("bag_a") - F.length("bag_b")) <= 1) & (F.levenshtein("bag_a", "bag_b", CHANGED) >= 0)
    pairs = a.join(b, "sig").where(alike).select("bag_a", "bag_b").distinct()
    of = lambda x: bagged.select(F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"), F.col("bag").alias(f"bag_{x}"))
    close = pairs.join(of("a"), "bag_a").join(of("b"), "bag_b").where(F.levenshtein("word_a", "word_b", 1) == 1)
    row = lambda x, y: F.struct(F.col(f"word_{x}").alias("word"), F.col(f"word_{y}").alias("other"), F.col(f"n_{y}").alias("other_n"))
    return close.select(F.explode(F.array(row("a", "b"), row("b", "a"))).alias("r")).select("r.*")


def roots(forms: DataFrame) -> DataFrame:
    """Where the forms of `forms` (word, form) lead: word, root. Each round doubles the way that is known; forms are more frequent than their words, so there are no circles."""
    known = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # many words may share a root, each word has one row ahead
        step = cut(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(counts: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """Distinct words with their counts (`word`, `n`) grouped by spelling: n_near, form, form_n and root of each.

    Near words differ by one letter put in, left out or replaced. The form of a
    word is its near word of largest n (ties: the first by code points) if that n
    is `ratio` times its own at least; the root is where forms lead, or the word.
    An empty table gives no rows; rows with a null word are left out. Other
    columns play no part.
    """
    words = counts.where("word is not null").select("word", "n")
    near = near_words(words, parts)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    found = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "spelling")
    lead = roots(found.where("form is not null"))
    return found.join(lead, "word", "left").withColumn("root", F.coalesce("root", "word"))


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = EDIT_EVERY) -> DataFrame:
    """The words of `docs` (doc_id, text) with slips, of so many letters and occurrences at least: word, n. Repeated rows count each time."""
    word = with_slips(runs(docs), every).where(F.length("word") >= min_letters)
    return cut(word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "spelling-words")


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_BYTES = "list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)"
ORACLE = f"""WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), t AS (SELECT {_CRC_TABLE} AS crc
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h
  FROM (SELECT run, k, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM runs), t
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % {EDIT_EVERY} = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}
), cuts AS (
  SELECT word, n, left(word, i - 1) AS a, substr(word, i + 1) AS z, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON y.word = x.a || x.z
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON y.word = x.a || x.z
), best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, min(e.other) AS form, CASE WHEN min(e.other) IS NOT NULL THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN near e ON e.word = w.word AND e.n = b.most AND b.most >= {RATIO} * w.n GROUP BY w.word, w.n, b.n_near, b.most
), ways AS (
  SELECT word, form AS lead, 1 AS k FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT ways.word, formed.form, k + 1 FROM ways JOIN formed ON formed.word = ways.lead WHERE formed.form IS NOT NULL
), roots AS (SELECT word, arg_max(lead, k) AS root FROM ways GROUP BY word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(r.root, f.word) AS root FROM formed f LEFT JOIN roots r ON r.word = f.word"""
