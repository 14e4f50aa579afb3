"""Evidence per post and profile, the decision table, and one category per post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.match import keyword_counts, lexicon_occurrences, posts_text, profile_hits
from sluice.sources.lexicon import MAX_PROFILES
from sluice.sources.store import bounded

#: Decisions, here and in the table below with their reasons, as audit rows have them.
REJECT, REVIEW, DIRECT = "reject", "review", "direct"
LISTS = (("positive", "core"), ("positive", "supporting"), ("negative", "core"), ("negative", "supporting"))


def decision_table() -> tuple[Column, Column]:
    """Decision and reason; the first rule that fits wins."""
    core_p, core_n = F.col("core_positive_count") > 0, F.col("core_negative_count") > 0
    title_p, title_n = F.col("title_core_positive"), F.col("title_core_negative")
    titled = title_p & ~title_n
    rules = [
        (F.col("hard_reject"), REJECT, "hard_reject_keyword"),
        (titled & core_n, REVIEW, "title_positive_but_body_core_negative"),
        (titled & (F.col("supporting_negative_weight") >= F.col("t_title_neg")), REVIEW, "title_core_positive_but_heavy_supporting_negative"),
        (titled, DIRECT, "title_core_positive"),
        (title_n & ~title_p & ~core_p, REJECT, "title_core_negative_no_body_positive"),
        (core_p & core_n, REVIEW, "mixed_core_signals"),
        (core_n, REJECT, "core_negative_no_core_positive"),
        (core_p & (F.col("core_positive_count") == 1) & (F.col("supporting_positive_weight") < F.col("t_lone_core")), REVIEW, "lone_core_positive_insufficient_support"),
        (core_p & (F.col("supporting_negative_weight") >= F.col("t_neg_downgrade")), REVIEW, "core_positive_but_heavy_supporting_negative"),
        (core_p, DIRECT, "core_positive_clean"),
        (F.col("supporting_positive_weight") >= F.col("t_min_support"), REVIEW, "supporting_positive_only"),
    ]
    decision, reason = F.lit(REJECT), F.lit("insufficient_signal")
    for when, d, r in reversed(rules):
        decision, reason = F.when(when, d).otherwise(decision), F.when(when, r).otherwise(reason)
    return decision, reason


def classify_all(jobs: DataFrame, profiles: DataFrame, lexicon: DataFrame, key: str = "job_uuid") -> DataFrame:
    """One row per post and enabled profile with evidence, decision and reason; posts without any hit too.

    `jobs` has key, title and description; `lexicon` is compiled. Texts are
    looked through once; keywords are counted by post, then gathered by profile.
    Only the profiles are broadcast to every post, not their keywords.
    """
    enabled = profiles.where("enabled").withColumnRenamed("id", "profile_id")
    own = lexicon.join(enabled.select("profile_id"), "profile_id", "left_semi")
    found = profile_hits(keyword_counts(lexicon_occurrences(posts_text(jobs, key), own, key=key), own, key), LISTS, key)
    joined = jobs.select(key).crossJoin(bounded(enabled, MAX_PROFILES, "profiles")).join(found, [key, "profile_id"], "left")
    names = [f"{p}_{t}" for p, t in LISTS]
    listed = joined.withColumns({f"{n}_hits": F.coalesce(f"{n}_hits", F.array().cast("array<struct<ord:int,keyword:string,weight:int,group:string>>")) for n in (*names, "hard")})
    weight = lambda n: F.aggregate(f"{n}_hits", F.lit(0), lambda a, x: a + x["weight"])
    groups = lambda p: F.array_sort(F.array_distinct(F.transform(F.concat(f"{p}_core_hits", f"{p}_supporting_hits"), lambda x: x["group"])))
    plain = lambda n: F.transform(f"{n}_hits", lambda x: F.struct(x["keyword"].alias("keyword"), x["weight"].alias("weight"), x["group"].alias("group")))
    filled = listed.select(
        key, "profile_id", *(c for c in profiles.columns if c != "id"),
        *(F.size(f"{p}_core_hits").alias(f"core_{p}_count") for p in ("positive", "negative")), *(weight(f"{p}_supporting").alias(f"supporting_{p}_weight") for p in ("positive", "negative")),
        (F.size("positive_core_hits") + F.size("positive_supporting_hits") > 0).alias("matched"), *(groups(p).alias(f"{p}_groups") for p in ("positive", "negative")), *(plain(n).alias(f"{n}_matches") for n in names),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("title_core_positive", "title_core_negative")),
        F.transform("hard_hits", lambda x: x["keyword"]).alias("hard_reject_matches"), (F.size("hard_hits") > 0).alias("hard_reject"),
    )
    decision, reason = decision_table()
    return filled.withColumns({"decision": decision, "reason": reason})


def select_category(results: DataFrame, key: str = "job_uuid") -> DataFrame:
    """One row per post: selected profile (exactly one direct match and no review), candidates, whether it needs arbitration."""
    direct, review = F.col("decision") == DIRECT, F.col("decision") == REVIEW
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("profile_ord", "profile_id")))), lambda x: x["profile_id"])
    rolled = results.groupBy(key).agg(
        F.count_if(direct).cast("int").alias("n_direct"), F.count_if(review).cast("int").alias("n_review"), ids(direct | review).alias("candidates"),
        ids(review).alias("review_ids"), ids(direct).alias("direct_ids"), ids(F.lit(True)).alias("all_ids"),
    )
    one = (F.col("n_direct") == 1) & (F.col("n_review") == 0)
    return rolled.select(
        key, "n_direct", "n_review", "candidates", "review_ids", "all_ids", F.when(one, F.get("direct_ids", 0)).alias("selected"),
        F.when(F.col("n_review") == 1, F.get("review_ids", 0)).alias("single_review"), (F.col("n_direct") > 0).alias("has_direct"),
        (~one & ((F.col("n_review") > 0) | (F.col("n_direct") > 1))).alias("needs_arbitration"),
    )


def representative(results: DataFrame, selection: DataFrame, key: str = "job_uuid") -> DataFrame:
    """The evidence row that stands for a post: the selected profile's, else the first candidate's, else the first profile's."""
    wanted = selection.select(key, F.coalesce("selected", F.get("candidates", 0), F.get("all_ids", 0)).alias("profile_id"))
    return results.join(wanted, [key, "profile_id"])


def final_decision(results: DataFrame, selection: DataFrame, key: str = "job_uuid", jobs: DataFrame | None = None) -> DataFrame:
    """Final decision, reason, category and method of each post before any review; posts that wait for one are null.

    The classifier's reason stays in `filter_reason`. With `jobs`, their posts
    that no profile was asked about, since none is enabled, are rejected.
    """
    if jobs is not None:
        none_asked = jobs.select(key).distinct().join(selection.select(key), key, "left_anti")
        empty = {"n_direct": 0, "n_review": 0, "candidates": [], "review_ids": [], "all_ids": [], "has_direct": False, "needs_arbitration": False}
        literal = lambda c, v: (F.array() if v == [] else F.lit(v)).cast(selection.schema[c].dataType).alias(c)
        selection = selection.unionByName(none_asked.select(key, *(literal(c, v) for c, v in empty.items())), allowMissingColumns=True)
    first = representative(results, selection, key).select(key, "hard_reject", "matched", F.col("reason").alias("filter_reason"))
    rejected = F.when(F.col("hard_reject"), "Hard Reject").when(~F.col("matched"), "No Matching Keywords").otherwise(F.coalesce("filter_reason", F.lit("No Matching Categories")))
    none = F.size("candidates") == 0
    picked = F.col("selected").isNotNull()
    return selection.join(first, key, "left").select(
        key, F.when(picked, "Accepted").when(none, "Rejected").alias("final_decision"),
        F.when(picked, F.coalesce("filter_reason", F.lit("Direct Category Match"))).when(F.size("all_ids") == 0, "No Enabled Categories").when(none, rejected).alias("decision_reason"),
        F.col("selected").alias("category_id"), F.when(picked, "keyword_direct").alias("selection_method"), F.when(picked, "Pending").alias("notification_status"),
        "candidates", "needs_arbitration", "filter_reason",
    )


def apply_review(decided: DataFrame, responses: DataFrame, key: str = "job_uuid") -> DataFrame:
    """Settles posts that need arbitration with validated `responses` (key, selected_category, reason; null category: the providers failed).

    An answer `none` rejects; an id that is no candidate is an error, and like a
    missing answer rejects with `LLM Error`.
    """
    said = responses.select(key, F.col("selected_category").alias("said"), F.col("reason").alias("said_reason"))
    joined = decided.join(said, key, "left")
    waits, chosen = F.col("needs_arbitration"), F.array_contains("candidates", F.col("said"))
    accepted = waits & F.coalesce(chosen, F.lit(False))
    refused = waits & (F.col("said") == "none")
    pick = lambda yes, c: F.when(accepted, yes).otherwise(F.col(c))
    return joined.select(
        key, F.when(accepted, "Accepted").when(waits, "Rejected").otherwise(F.col("final_decision")).alias("final_decision"),
        F.when(accepted, F.col("said_reason")).when(refused, F.coalesce(F.nullif("said_reason", F.lit("")), F.lit("LLM Arbitration: No Category"))).when(waits, "LLM Error").otherwise(F.col("decision_reason")).alias("decision_reason"),
        pick(F.col("said"), "category_id").alias("category_id"), pick(F.lit("llm"), "selection_method").alias("selection_method"), pick(F.lit("Pending"), "notification_status").alias("notification_status"),
        "candidates", F.coalesce(accepted, F.lit(False)).alias("reviewed"),
    )
