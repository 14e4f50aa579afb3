"""Keyword matching: words meet the keywords anchored at them in one broadcast join, longest keywords claim their words first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import bound, normalize_text
from sluice.sources.lexicon import MAX_ROWS
from sluice.sources.store import bounded

TIER = ("profile_id", "polarity", "tier")


def posts_text(jobs: DataFrame, key: str = "job_uuid") -> DataFrame:
    """Normalised words of title and description (`norm`), and how many are the title's."""
    # they are normalised apart, each once: the line feed between them parts words
    both = jobs.select(key, normalize_text(F.col("title")).alias("name"), normalize_text(F.col("description")).alias("body"))
    return both.select(key, F.trim(F.concat_ws(" ", "name", "body")).alias("norm"), F.size(F.array_remove(F.split("name", " "), "")).alias("n_title"))


def lexicon_occurrences(texts: DataFrame, lexicon: DataFrame, key: str = "job_uuid") -> DataFrame:
    """Every occurrence of every keyword of a compiled lexicon, whatever its number of words: key, profile, polarity, tier, ord, first word `pos`, `n_tokens`, `in_title`.

    Each word of a text meets the keywords anchored at it, their rarest word, in
    one broadcast join; where the anchor is there, the words around it are
    compared with the keyword's.
    """
    # an inner explode would put a filter below the parsing, which would then be done twice; what an outer one adds meets no keyword
    each = texts.select(key, "n_title", F.split("norm", " ").alias("w"))
    each = each.select(key, "n_title", "w", F.posexplode_outer("w").alias("spot", "anchor"))
    terms = lexicon.select(*TIER, "ord", "n_tokens", "anchor", "offset", "words")
    pos = F.col("spot") - F.col("offset")
    fits = (F.col("n_tokens") == 1) | ((pos >= 0) & (pos + F.col("n_tokens") <= F.size("w")) & (F.slice("w", F.greatest(pos, F.lit(0)) + 1, F.col("n_tokens")) == F.col("words")))
    met = each.join(bounded(terms, MAX_ROWS, "keywords"), "anchor").where(fits)
    return met.select(key, *TIER, "ord", pos.alias("pos"), "n_tokens", (pos + F.col("n_tokens") <= F.col("n_title")).alias("in_title"))


def keyword_counts(occurrences: DataFrame, lexicon: DataFrame, key: str = "job_uuid") -> DataFrame:
    """One row for each keyword that a post has: its number of occurrences `n`, `in_title`, places (`at`, of phrases only), and the lexicon's keyword, weight, group and `inner`.

    Single words are only counted, so they are combined before the shuffle.
    """
    counted = occurrences.groupBy(key, *TIER, "ord", "n_tokens").agg(
        F.count("*").cast("int").alias("n"), F.bool_or("in_title").alias("in_title"), F.collect_list(F.when(F.col("n_tokens") > 1, F.col("pos"))).alias("at")
    )
    return counted.join(bounded(lexicon.select(*TIER, "ord", "keyword", "weight", "group", "inner"), MAX_ROWS, "keywords"), [*TIER, "ord"])


ENTRY = ("ord", "keyword", "weight", "group", "n_tokens", "n", "at", "inner")
SPAN = "array<struct<ord:int,pos:int,n_tokens:int,inner:array<int>>>"


def _meets(a: Column, b: Column) -> Column:
    return (a["pos"] < b["pos"] + b["n_tokens"]) & (b["pos"] < a["pos"] + a["n_tokens"])


def laid_out(spans: Column) -> Column:
    """Of `spans` those that stay when they are laid out by keyword order, then place, none over an earlier one.

    Of one tier, whose longest phrase here has n words, at most n - 1 phrases
    begin at a word, so a span that meets another has it among its nearest
    neighbours by place. Only spans that meet others are laid out one after the
    other.
    """
    longest = F.array_max(F.transform(spans, lambda x: x["n_tokens"]))
    near = longest * (longest - 1)
    by_place = F.sort_array(F.transform(spans, lambda x: F.struct(x["pos"].alias("pos"), x["n_tokens"].alias("n_tokens"), x["ord"].alias("ord"), x["inner"].alias("inner"))))

    def split(p: Column) -> Column:
        around = lambda i: F.slice(p, F.greatest(i - near, F.lit(0)) + 1, 2 * near + 1)
        met = lambda x, i: F.exists(around(i), lambda y: _meets(x, y) & ((x["pos"] != y["pos"]) | (x["ord"] != y["ord"])))
        told = F.transform(p, lambda x, i: F.struct(met(x, i).alias("met"), F.struct(x["ord"].alias("ord"), x["pos"].alias("pos"), x["n_tokens"].alias("n_tokens"), x["inner"].alias("inner")).alias("span")))
        of = lambda met: F.transform(F.filter(told, lambda t: t["met"] == met), lambda t: t["span"])
        one_by_one = F.aggregate(
            F.sort_array(of(True)), F.array().cast(SPAN), lambda kept, x: F.when(F.exists(kept, lambda k: _meets(k, x)), kept).otherwise(F.array_append(kept, x))
        )
        return F.concat(of(False), one_by_one)

    return F.when(F.size(spans) > 1, bound(by_place, split)).otherwise(spans)


def kept_entries(entries: str) -> Column:
    """Of a tier's keywords in a post (`entries`, as ENTRY) those with an occurrence left when longer ones take their words first, in order.

    A laid out phrase takes one occurrence of each keyword that is a word of it
    (`inner`), so a single word stays if it occurs more often than that.
    """
    phrases = F.filter(entries, lambda e: e["n_tokens"] > 1)
    spans = F.flatten(F.transform(phrases, lambda e: F.transform(e["at"], lambda p: F.struct(e["ord"].alias("ord"), p.alias("pos"), e["n_tokens"].alias("n_tokens"), e["inner"].alias("inner")))))

    def kept(laid: Column) -> Column:
        at, taken = F.array_distinct(F.transform(laid, lambda s: s["ord"])), F.flatten(F.transform(laid, lambda s: s["inner"]))
        stays = lambda e: F.when(e["n_tokens"] > 1, F.array_contains(at, e["ord"])).otherwise(e["n"] > F.size(F.filter(taken, lambda o: o == e["ord"])))
        return F.filter(entries, stays)

    return F.when(F.size(phrases) == 0, F.sort_array(entries)).otherwise(F.sort_array(bound(bound(spans, laid_out), kept)))


def tier_hits(counts: DataFrame, key: str = "job_uuid") -> DataFrame:
    """Keywords (key, profile, polarity, tier, ord) of `keyword_counts` that keep an occurrence when longer ones of their tier take their words first."""
    per = counts.where("tier <> 'hard'").groupBy(key, *TIER).agg(F.collect_list(F.struct(*ENTRY)).alias("entries"))
    return per.select(key, *TIER, F.explode(kept_entries("entries")).alias("e")).select(key, *TIER, "e.ord")


def profile_hits(counts: DataFrame, tiers: Sequence[tuple[str, str]], key: str = "job_uuid") -> DataFrame:
    """All that a post's keywords say about a profile, in one shuffle: the hits (ord, keyword, weight, group) of each of `tiers` and of the hard tier, title signals."""
    of = {f"{p}_{t}": (F.col("polarity") == p) & (F.col("tier") == t) for p, t in tiers}
    entry, hit = F.struct(*ENTRY), F.struct("ord", "keyword", "weight", "group")
    title = lambda p: F.bool_or((F.col("polarity") == p) & (F.col("tier") == "core") & F.col("in_title"))
    per = counts.groupBy(key, "profile_id").agg(
        *(F.collect_list(F.when(on, entry)).alias(n) for n, on in of.items()), title("positive").alias("title_core_positive"), title("negative").alias("title_core_negative"),
        F.sort_array(F.collect_list(F.when(F.col("tier") == "hard", hit))).alias("hard_hits"),
    )
    plain = lambda e: F.struct(*(e[c].alias(c) for c in ("ord", "keyword", "weight", "group")))
    return per.select(key, "profile_id", "title_core_positive", "title_core_negative", "hard_hits", *(F.transform(kept_entries(n), plain).alias(f"{n}_hits") for n in of))


def hard_reject_hits(counts: DataFrame, key: str = "job_uuid") -> DataFrame:
    """Hard-reject keywords of `keyword_counts`, longest first, by key and profile; nothing is masked."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "keyword")))
    return counts.where("tier = 'hard'").groupBy(key, "profile_id").agg(F.transform(ordered, lambda x: x["keyword"]).alias("hard_reject_matches"))


def format_matches(matches: Column) -> Column:
    """keyword(weight/group), ... of a list of hits."""
    return F.array_join(F.transform(matches, lambda m: F.format_string("%s(%d/%s)", m["keyword"], m["weight"], m["group"])), ", ")


def format_prompt_matches(matches: Column) -> Column:
    """keyword (group, weight w), ... of a list of hits, or (none)."""
    text = F.array_join(F.transform(matches, lambda m: F.format_string("%s (%s, weight %d)", m["keyword"], m["group"], m["weight"])), ", ")
    return F.when(F.coalesce(F.size(matches), F.lit(0)) > 0, text).otherwise("(none)")
