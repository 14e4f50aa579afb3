"""Keywords of any number of words against masking one after the other."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import match
from sluice.sources import lexicon, store

WORDS = ["in", "of", "the", "a", "x1", "rare", "café", "sql"]


def table(spark, keywords, polarity="positive", tier="core"):
    rows = [("p", polarity, tier, "g", k, 1, n) for n, k in enumerate(keywords)]
    return lexicon.compile_lexicon(spark.createDataFrame(rows, lexicon.LEXICON))


def masked(text: str, keywords: list[str]) -> set[str]:
    """Longest first, each blanks all it matches."""
    left, out = text.split(" "), set()
    for k in sorted(dict.fromkeys(keywords), key=lambda k: -len(k)):
        w, at = k.split(" "), 0
        while at + len(w) <= len(left):
            if left[at : at + len(w)] == w:
                out.add(k)
                left[at : at + len(w)] = [None] * len(w)
                at += len(w)
            else:
                at += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_keywords_of_one_to_eight_words(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    keywords = list(dict.fromkeys(draw(1 + k % 8) for k in range(60)))
    # keywords of equal length take turns by listing, so the brute force lists them alike
    texts = [draw(rng.randint(0, 12)) for _ in range(30)]
    texts += [" ".join([t, rng.choice(keywords), rng.choice(keywords), draw(3)]).strip() for t in texts]
    jobs = spark.createDataFrame([(str(k), "", t) for k, t in enumerate(texts)], "job_uuid string, title string, description string")
    lex = store.cut(table(spark, keywords), "lexicon")
    found = match.lexicon_occurrences(match.posts_text(jobs), lex)
    norm = lex.select(*match.TIER, "ord", "norm")
    places = collections.Counter((r.job_uuid, r.norm, r.pos) for r in found.join(norm, [*match.TIER, "ord"]).collect())
    want = collections.Counter((str(k), w, p) for k, t in enumerate(texts) for w in keywords for p in range(len(t.split())) if t.split()[p : p + len(w.split())] == w.split())
    assert places == want
    hits = match.tier_hits(match.keyword_counts(found, lex)).join(norm, [*match.TIER, "ord"]).groupBy("job_uuid").agg(F.collect_set("norm").alias("s")).collect()
    got = {r.job_uuid: set(r.s) for r in hits}
    assert got == {str(k): masked(t, keywords) for k, t in enumerate(texts) if masked(t, keywords)}


def test_long_hard_rejects_and_titles(spark):
    jobs = spark.createDataFrame([("1", "One two three four five", "six"), ("2", "x", "this is no place for unpaid work at all"), ("3", None, None)], "job_uuid string, title string, description string")
    texts = match.posts_text(jobs)
    lex = table(spark, ["one two three four five", "five six"])
    assert {(r.job_uuid, r.n_tokens, r.in_title) for r in match.lexicon_occurrences(texts, lex).collect()} == {("1", 5, True), ("1", 2, False)}
    hard = table(spark, ["no place for unpaid work at", "unpaid"], "hard_reject", "hard")
    counts = match.keyword_counts(match.lexicon_occurrences(texts, hard), hard)
    assert [tuple(r) for r in match.hard_reject_hits(counts).collect()] == [("2", "p", ["no place for unpaid work at", "unpaid"])]


def joined(texts, lex, anchor):
    """Rows of the join of words with keywords by a word of theirs."""
    words = texts.select(F.explode(F.split("norm", " ")).alias("word"))
    return words.join(lex.select(anchor.alias("word")), "word").count()


@pytest.mark.parametrize("n", [2_600, 20_000])
def test_rarest_word_meets_less_than_the_first(spark, n):
    """A generated lexicon whose phrases begin with frequent words, as phrases do."""
    rng = random.Random(n)
    rows = [("p", "positive", "core", "g", f"{rng.choice(['in', 'of', 'the', 'a'])} {rng.choice(['in', 'the', 'sql'])} w{rng.randrange(n)} {rng.choice(['of', 'rare'])}", 1, k) for k in range(n)]
    lex = store.cut(lexicon.compile_lexicon(spark.createDataFrame(rows, lexicon.LEXICON)), "lexicon")
    texts = spark.createDataFrame([(str(k), 0, " ".join(rng.choice([*WORDS, f"w{rng.randrange(n)}"]) for _ in range(60))) for k in range(50)], "job_uuid string, n_title int, norm string")
    assert joined(texts, lex, F.col("anchor")) * 100 < joined(texts, lex, F.substring_index("norm", " ", 1))
    counts = spark.createDataFrame([("w", 10**9), ("rare", 1)], "word string, n long")
    told = lexicon.compile_lexicon(spark.createDataFrame([("p", "positive", "core", "g", "w rare w w", 1, 0)], lexicon.LEXICON), counts).first()
    assert (told.anchor, told.offset, told.n_tokens) == ("rare", 1, 4)


def test_tables_for_every_task_are_counted(spark):
    assert store.bounded(spark.range(3), 3, "rows").count() == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        store.bounded(spark.range(3), 2, "rows")


def test_words_of_posts_need_no_paragraphs(spark):
    """Titles and descriptions that keep their blanks have the words of those that are laid out in paragraphs."""
    from sluice.operators.parse import ARABIC, parse_posts

    texts = [
        "  \n Title one \r\n a\x85b\xa0c \r d\n\n\n\ne  \t f", "ΟΔΟΣ\nΟΔΟΣ\nΣ Σ\x1cΣ x　", "T\x0bgone\nline\x1f\n \n\x1d two", "", None, "one line", "\n\n", "é\nـً أب\n\tآ ",
        f"{ARABIC.title} : t 1\n{ARABIC.description}:  a \n\n\n b\x1e\nc \n{ARABIC.budget}: 5", f"x\n{ARABIC.description}:",
    ]
    posts = spark.createDataFrame([(2 * k + n, source, t) for k, t in enumerate(texts) for n, source in enumerate(("feed", "a labelled feed"))], "job_uuid int, source string, text string")
    laid, plain = (match.posts_text(parse_posts(posts, paragraphs=p)).orderBy("job_uuid").collect() for p in (True, False))
    assert laid == plain and sum(r["norm"] != "" for r in plain) > 10
