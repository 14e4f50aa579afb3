"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

All of it is built-in Spark functions. One pass over the texts leaves a few
numbers per document in a table; the vote patterns of all documents (at most
3^11, whatever the corpus) are counted, and each round of
expectation-maximisation is one aggregation over those counts.

The model has one class of good documents and one of each kind of junk (KINDS),
with the probabilities of every rule's votes in each. A kind starts out as what
its own rules vote against; pseudo-documents keep it from drifting off. A rule
whose alarms the others of its kind don't share comes out as inaccurate, so its
lone alarm is outvoted. The posterior quality is that of the class of good ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, row_key, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which a document fails outright.
MAX_REPEAT_PERCENT = 50
#: Documents whose posterior probability of being good is at least this are kept.
KEEP_AT = 0.5
ROUNDS = 15
#: Kinds of junk, and the rules that see each: two or more, so that they bear each other out.
KINDS = {
    "markup": ("symbols", "symbol_runs"), "list": ("symbols", "bare_words"), "shouting": ("capitals", "marks"),
    "repetition": ("repeats", "lines", "variety"), "form": ("word_length", "sentences"),
}
#: Where expectation-maximisation starts: the share of good documents, and probabilities of a good vote, an abstention and a bad vote for good documents, and for junk from its own and from other rules.
START = 0.9
GOOD, OWN, OTHER = (0.85, 0.14, 0.01), (0.2, 0.2, 0.6), (0.6, 0.25, 0.15)
#: Each class has pseudo-documents that vote as at the start: as many as this share of all documents, and one more.
PRIOR_SHARE = 0.005


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, key_text (see row_key) and the counts that the rules look at, one row per row of `docs`; null texts count as empty.

    A 3-word window is repeated if its words occur as a window elsewhere in the
    text. Windows are sorted by hash within the row, and neighbours compared by
    their words, so nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", row_key()[1], text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("w")
    gram = F.slice(F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    counted = base.select(
        "doc_id", "key_text", "w", n.alias("n"), lines.alias("l"), gram.alias("g"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).alias("n_symbols"),
        F.regexp_count("t", F.lit(SYMBOLS + "{2,}")).alias("n_runs"),
        F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).alias("n_bare"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("t", F.lit(r"[!?]")).alias("n_marks"),
        F.regexp_count("t", F.lit(r"[.!?](?:\s|$)")).alias("n_ends"),
    )
    # Sorting is left out where all windows differ.
    order = F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>"))

    def same(a: Column, b: Column) -> Column:
        word = lambda x, k: F.get("w", x["i"] + k)
        return (a["h"] == b["h"]) & (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2))

    ordered = counted.withColumn("s", order)
    twice = F.filter("s", lambda x, i: F.coalesce(same(x, F.get("s", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("s", i + 1)), F.lit(False)))
    placed = ordered.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    long = lambda c: F.col(c).cast("long").alias(c)
    return placed.select(
        "doc_id", "key_text", F.col("n").cast("long").alias("n_words"), long("word_chars"), long("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        long("n_runs"), long("n_bare"), long("n_upper"), long("n_marks"), long("n_ends"),
    )


def votes() -> dict[str, Column]:
    """The rules: 1 for good, -1 for bad, 0 for no opinion."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.col(c) / n

    def vote(bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, -1).when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / n
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": vote(rate("n_symbols") > 0.1, rate("n_symbols") < 0.03),
        "symbol_runs": vote(rate("n_runs") > 0.02, rate("n_runs") < 0.005),
        "bare_words": vote(rate("n_bare") > 0.15, rate("n_bare") < 0.05),
        "capitals": vote(upper > 0.45, upper < 0.2),
        "marks": vote(rate("n_marks") > 0.3, rate("n_marks") < 0.08),
        "repeats": vote(rate("n_repeat_words") > 0.35, rate("n_repeat_words") < 0.2),
        "lines": vote(dup > 0.3, (F.col("n_lines") > 1) & (dup < 0.1)),
        "variety": vote(rate("n_distinct") < 0.08, rate("n_distinct") > 0.2),
        "word_length": vote((mean < 2) | (mean > 15), (mean > 3) & (mean < 12)),
        "sentences": vote(rate("n_ends") < 0.003, rate("n_ends") > 0.01),
        "length": vote(F.lit(False), F.col("n_words") >= 60),
    }


def pattern(rules: dict[str, Column]) -> Column:
    """The votes as one number: digit k to base 3 is rule k's vote, 2 for good."""
    return sum(((v + 1) * 3**k for k, v in enumerate(rules.values())), F.lit(0)).cast("int")


def slots(n_rules: int) -> Column:
    """For each rule of a `pattern` the place of its vote in a list of all rules' vote probabilities."""
    return F.array(*(F.lit(3 * k) + F.floor(F.col("pattern") / 3**k).cast("int") % 3 for k in range(n_rules)))


def start(names: list[str]) -> tuple[list[float], list[list[float]]]:
    """The model before any data: shares of the good class and of KINDS, and for each its probabilities of a bad vote, abstention, good vote of rule after rule."""
    votes_of = lambda k, c: OWN if c in KINDS.get(k, ()) else GOOD if k == "good" else OTHER
    shares = [START, *((1 - START) / len(KINDS) for _ in KINDS)]
    return shares, [[p for c in names for p in reversed(votes_of(k, c))] for k in ("good", *KINDS)]


def posteriors(patterns: DataFrame, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """`patterns` (with `slots`) with `p`, the probability of each class."""
    logs = F.array(*(F.struct(F.lit(math.log(share)).alias("share"), F.array(*(F.lit(math.log(p)) for p in of)).alias("votes")) for share, of in zip(*model, strict=True)))
    fit = F.transform(logs, lambda m: F.aggregate("slots", m["share"], lambda a, s: a + F.get(m["votes"], s)))
    weighed = patterns.withColumn("fit", fit).withColumn("weight", F.transform("fit", lambda x: F.exp(x - F.array_max("fit"))))
    total = F.aggregate("weight", F.lit(0.0), lambda a, x: a + x)
    return weighed.withColumn("total", total).select(*patterns.columns, F.transform("weight", lambda x: x / F.col("total")).alias("p"))


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[list[float], list[list[float]]]:
    """Shares of the classes and their vote probabilities, by expectation-maximisation.

    `patterns` has a row for each vote pattern with its count `n` and `slots`.
    Each round weighs the patterns by the last model's posteriors and takes the
    weighted shares, pseudo-documents included, as the next model; an empty
    corpus leaves it where it starts.
    """
    first = start(names)
    model = first
    for _ in range(rounds):
        weighed = posteriors(patterns, model).select("slots", F.posexplode(F.transform("p", lambda x: x * F.col("n"))).alias("class", "g"))
        each = weighed.select("class", "g", F.explode(F.concat(F.array(F.lit(-1)), "slots")).alias("slot"))
        seen = {(r["class"], r["slot"]): r["g"] for r in each.groupBy("class", "slot").agg(F.sum("g").alias("g")).collect()}
        share = [seen.get((k, -1), 0.0) for k in range(len(first[0]))]
        pseudo = PRIOR_SHARE * sum(share) + 1
        model = (
            [(g + p * pseudo) / (sum(share) + pseudo) for g, p in zip(share, first[0], strict=True)],
            [[(seen.get((k, s), 0.0) + p * pseudo) / (share[k] + pseudo) for s, p in enumerate(of)] for k, of in enumerate(first[1])],
        )
    return model


def quality_rules(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Base counts, votes and verdict per row of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts have no words, so they fail the base rules. Equal rows
    get equal results. An empty table gives an empty table. kept is false where
    base_failed, else p_good >= keep_at.
    """
    rules = votes()
    stats = cut(text_stats(docs).withColumn("pattern", pattern(rules)), "quality-rules")
    patterns = cut(stats.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("slots", slots(len(rules))).coalesce(1), "quality-votes")
    judged = posteriors(patterns, fit(patterns, list(rules))).select("pattern", F.get("p", 0).alias("p_good"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.join(F.broadcast(judged), "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("p_good") >= keep_at)).alias("kept"), F.round("p_good", 6).alias("p_good"),
    )
