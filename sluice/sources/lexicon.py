"""Profiles and their keywords as tables; small tables of our own for tests and the driver's prose."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.text import normalize_text

PROFILES = "profile_ord int, id string, name string, description string, scope string, enabled boolean, t_min_support int, t_neg_downgrade int, t_lone_core int, t_title_neg int"
LEXICON = "profile_id string, polarity string, tier string, group string, keyword string, weight int, src_ord int"
#: Keywords, and profiles, are sent to every task, so there may be at most this many.
MAX_ROWS, MAX_PROFILES = 200_000, 10_000

#: Phrases of the driver's prose, by profile, polarity, tier and group.
PROSE: Mapping[str, Mapping[str, Mapping[str, Mapping[str, Mapping[str, int]]]]] = {
    "english": {
        "positive": {"core": {"phrases": {"of the": 8, "in the": 8, "of the and": 9}}, "supporting": {"words": {"the": 3, "and": 2, "with": 4, "that": 5, "the and": 6}}},
        "negative": {"core": {"german": {"in der": 8, "und die": 9}}, "supporting": {"romance": {"de la": 5, "la": 3, "der": 4, "que": 5}}},
        "hard_reject": {"hard": {"spam": {"casino": 1, "un de la": 1}}},
    },
    "german": {
        "positive": {"core": {"articles": {"in der": 8, "der die": 8, "und die": 7}}, "supporting": {"words": {"und": 3, "der": 3, "die": 2, "mit": 4, "der und": 6}}},
        "negative": {"core": {"english": {"of the": 8}}, "supporting": {"words": {"the": 5, "and": 5, "la": 4}}},
        "hard_reject": {"hard": {"spam": {"casino": 1}}},
    },
    "romance": {
        "positive": {"core": {"phrases": {"de la": 8, "la de": 7, "en la": 9}}, "supporting": {"words": {"de": 2, "la": 3, "que": 4, "en": 3, "les": 4}}},
        "negative": {"core": {"english": {"in the": 8, "of the": 7}}, "supporting": {"words": {"the": 5, "und": 5}}},
        "hard_reject": {"hard": {"spam": {"pills": 1, "of of of": 1}}},
    },
}


def prose_profiles(spark: SparkSession) -> DataFrame:
    rows = [(k, p, p.title(), f"Prose in {p}", f"Texts mostly in {p}", True, 12, 14, 5, 10) for k, p in enumerate(PROSE)]
    return spark.createDataFrame(rows, PROFILES)


def flatten_profile(profile_id: str, nested: Mapping) -> list[tuple]:
    """Rows of LEXICON from {polarity: {tier: {group: {keyword: weight}}}}."""
    flat = [(polarity, tier, group, keyword, weight) for polarity, tiers in nested.items() for tier, groups in tiers.items() for group, words in groups.items() for keyword, weight in words.items()]
    return [(profile_id, *row, k) for k, row in enumerate(flat)]


def lexicon_table(spark: SparkSession, profiles: Mapping[str, Mapping] = PROSE) -> DataFrame:
    """All keywords of the given profiles, one row each."""
    rows = [r for p, nested in profiles.items() for r in flatten_profile(p, nested)]
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} keywords")
    return spark.createDataFrame(rows, LEXICON)


def compile_lexicon(lexicon: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds to keywords, of any number of words, what matching needs.

    `norm` and its `words`, `n_tokens`; `ord`, the longest-first order within
    profile, polarity and tier; `inner`, for a phrase the ords of its words that
    are keywords of its tier; and `anchor`, its rarest word, with its place
    `offset`. Rare are words that few keywords hold, and of those the longer;
    with `counts` (word, n) of a corpus, the words with the lowest n there.

    Keywords that normalise to nothing go; of keywords of a tier that normalise
    alike only the first can ever hit, so the others go too.
    """
    tier = Window.partitionBy("profile_id", "polarity", "tier")
    norm = lexicon.withColumn("norm", normalize_text(F.col("keyword"))).where("norm <> ''")
    rank = F.row_number().over(Window.partitionBy("profile_id", "polarity", "tier", "norm").orderBy("src_ord", "keyword"))
    first = norm.withColumn("rank", rank).where("rank = 1").drop("rank")
    order = (F.length("norm").desc(), F.when(F.col("polarity") == "hard_reject", F.col("keyword")), "src_ord", "keyword")
    split = F.split("norm", " ")
    ranked = first.withColumns({"words": split, "n_tokens": F.size(split)}).withColumn("ord", F.row_number().over(tier.orderBy(*order)).cast("int"))
    words = ranked.where("n_tokens = 1").select("profile_id", "polarity", "tier", F.col("norm").alias("word"), F.col("ord").alias("word_ord"))
    keyword = ["profile_id", "polarity", "tier", "ord"]
    parts = ranked.select(*keyword, F.posexplode("words").alias("place", "word"))
    inner = parts.join(ranked.where("n_tokens > 1").select(*keyword), keyword, "left_semi").join(words, ["profile_id", "polarity", "tier", "word"]).groupBy(*keyword).agg(F.sort_array(F.collect_list("word_ord")).alias("inner"))
    known = parts.groupBy("word").agg(F.count("*").alias("held"))
    known = known.withColumn("seen", F.lit(0)) if counts is None else known.join(counts.select("word", F.col("n").alias("seen")), "word", "left")
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "held", (-F.length("word")).alias("less"), "place", "word")).alias("r")
    anchors = parts.join(known, "word").groupBy(*keyword).agg(rarest).select(*keyword, F.col("r.word").alias("anchor"), F.col("r.place").alias("offset"))
    return ranked.join(anchors, keyword).join(inner, keyword, "left").withColumn("inner", F.coalesce("inner", F.array().cast("array<int>")))


def lexicon_conflicts(lexicon: DataFrame, noise: DataFrame) -> DataFrame:
    """Noise words (profile_id, keyword) that the lexicon scores all the same; must be empty."""
    return lexicon.where("polarity <> 'hard_reject'").select("profile_id", "keyword").intersect(noise.select("profile_id", "keyword"))
