"""URL filter: fixed host rules first, association rules mined from labels for the rest.

FP-growth finds the token combinations that are frequent among pages with bad
labels. How many pages have each in all is counted through an inverted index, in
which a combination is filed under its rarest token. A combination is a rule if
bad labels are clearly more frequent with it than at large: by confidence, by a
bound on it that few pages loosen, and by no shorter rule doing as well. Rules
are matched through the same kind of index: a page looks up only its own tokens.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, join_by, small_side

#: (host, path, verdict): the longest rule that fits wins.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_HOST_RULES = 1000
#: How many times as frequent as at large bad labels must be with a rule.
MIN_LIFT = 1.5
#: Standard errors by which a rule's confidence must be above the share of bad labels (one-sided 95 %).
MARGIN = 1.645
#: Share of labelled pages, and number of labelled pages, that must have a token combination and a bad label.
MIN_SUPPORT = 0.0005
MIN_COUNT = 5
#: Rules up to this many tables rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (null: none)."""
    if len(rules) > MAX_HOST_RULES:
        raise ValueError(f"at most {MAX_HOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: words of the host, path parts without ids, names of parameters, extension, fragment."""

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    named = F.filter(F.split(path, "/"), lambda x: ~x.rlike(r"^\d+(\.\w+)?$"))
    return F.array_sort(F.array_distinct(F.concat(
        tagged("host:", F.split(host, r"[.-]")), tagged("path:", named),
        tagged("param:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
        tagged("ext:", F.array(F.regexp_extract(path, r"\.(\w{1,8})$", 1))), tagged("frag:", F.array(F.regexp_extract(url, r"#(\w*)", 1))),
    )))


def filed(antecedents: DataFrame, rows: DataFrame) -> DataFrame:
    """`antecedents` (with `members`) once for each token of one of their classes, as `item`: the class that the fewest `rows` (items, n) have; those that none has are left out."""
    spread = rows.select("n", F.explode("items").alias("item")).groupBy("item").agg(F.sum("n").alias("spread"))
    each = antecedents.select("antecedent", F.posexplode("members").alias("place", "class")).select("antecedent", "place", F.explode("class").alias("item"))
    held = each.join(small_side(cut(spread, "url-spread"), BROADCAST_ROWS), "item").groupBy("antecedent", "place").agg(F.sum("spread").alias("spread"))
    rarest = held.groupBy("antecedent").agg(F.min_by("place", F.struct("spread", "place")).alias("place"))
    return cut(antecedents.join(rarest, "antecedent").withColumn("item", F.explode(F.get("members", F.col("place")))).drop("place"), "url-index")


def matched(rows: DataFrame, index: DataFrame) -> DataFrame:
    """`rows` with the entries of a `filed` index of whose classes they all have a token."""
    return rows.withColumn("item", F.explode("items")).join(small_side(index, BROADCAST_ROWS), "item").where(F.forall("members", lambda m: F.arrays_overlap(m, F.col("items"))))


def classes(rows: DataFrame) -> DataFrame:
    """Classes of tokens of `rows` (items, n, n_bad; distinct items) that mining can't tell apart: `rep`, and `members`, its tokens.

    Tokens of exactly the same rows are one class, so mining one of them is
    mining all. Of classes that the same bad rows have, and so have equal n_bad
    in any rule, the one that the fewest rows have stays (ties: the first), which
    gives the highest confidence.
    """
    hashed = rows.select("n", "n_bad", F.xxhash64("items").alias("h"), F.xxhash64("items", F.lit(1)).alias("g"), F.explode("items").alias("item"))
    of_bad = lambda c: F.bit_xor(F.when(F.col("n_bad") > 0, F.col(c)).otherwise(0))
    seen = hashed.groupBy("item").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.sum("n").alias("n"), of_bad("h").alias("bad_h"), of_bad("g").alias("bad_g"), F.sum("n_bad").alias("n_bad"))
    same = seen.where("n_bad > 0").groupBy("h", "g", "n", "bad_h", "bad_g", "n_bad").agg(F.sort_array(F.collect_list("item")).alias("members"))
    return same.groupBy("bad_h", "bad_g", "n_bad").agg(F.min(F.struct("n", "members")).alias("least")).select(F.get("least.members", F.lit(0)).alias("rep"), "least.members")


def mine(labelled: DataFrame, bad: Column, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT, margin: float = MARGIN) -> DataFrame:
    """Rules (antecedent, members, n, n_bad, confidence, lift) "these tokens go with a bad label", from rows with `items`.

    An antecedent names one token of each of its classes; `members` are all
    tokens of each, any of which will do (see `classes`). So a page that comes
    many times, however long its url, is mined as one token.

    n and n_bad are the labelled rows with all tokens, and the bad ones of them.
    The confidence n_bad / n is at least `min_lift` times the share of bad rows,
    and the lower end of its score interval (`margin` standard errors) is above
    that share. n_bad is at least `min_count` and `min_support` of all rows.
    Rows with equal tokens are counted first. Tokens that all rows have say
    nothing and are left out, as is a rule with a shorter one in it, by one
    token, that has at least its confidence. Without good or bad rows there are
    no rules.
    """
    learnt = cut(labelled.select("items", bad.alias("bad")), "url-labelled")
    rows = cut(learnt.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")), "url-rows")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_bad")).first()
    least = max(min_count, math.ceil(min_support * total["n"]))
    everywhere = rows.select("n", F.explode("items").alias("item")).groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") == total["n"]).select(F.col("item").alias("common"))
    common = everywhere.agg(F.collect_list("common").alias("common")).first()["common"]  # at most as many as the shortest row has
    own = F.array_except("items", F.array(*map(F.lit, common)).cast("array<string>"))
    told = cut(rows.withColumn("items", own).groupBy("items").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "url-told")
    of = cut(classes(told), "url-classes")
    each = told.select("items", "n", "n_bad", F.explode("items").alias("rep")).join(small_side(of.select("rep"), BROADCAST_ROWS), "rep")
    slim = cut(each.groupBy("items", "n", "n_bad").agg(F.sort_array(F.collect_list("rep")).alias("reps")).select(F.col("reps").alias("items"), "n", "n_bad"), "url-slim")
    if total["n_bad"] < least:
        candidates = told.select(F.col("items").alias("antecedent"), F.col("n").alias("n_bad")).limit(0)
    else:
        bad_rows = slim.where("n_bad > 0").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("n_bad").cast("int")))).select("items")
        n_rows = bad_rows.count()
        sets = FPGrowth(itemsCol="items", minSupport=min((least - 0.5) / max(n_rows, 1), 1.0)).fit(bad_rows).freqItemsets
        candidates = sets.where(F.col("freq") >= least).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n_bad"))
    candidates = cut(candidates.withColumn("members", F.transform("antecedent", lambda x: F.array(x))), "url-candidates")
    counted = matched(slim.select("items", "n"), filed(candidates, slim)).groupBy("antecedent", "n_bad").agg(F.sum("n").alias("n"))
    base = total["n_bad"] / max(total["n"], 1)
    share, z = F.col("n_bad") / F.col("n"), margin
    low = (share + z * z / (2 * F.col("n")) - z * F.sqrt(share * (1 - share) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    rules = counted.where((share >= min_lift * base) & (low > base)).select("antecedent", "n", "n_bad", share.alias("confidence"), (share / base if base else F.lit(0.0)).alias("lift"))
    rules = cut(rules, "url-rules")
    shorter = rules.where(F.size("antecedent") > 1).select("antecedent", "confidence", F.explode("antecedent").alias("item")).select("antecedent", "confidence", F.array_except("antecedent", F.array("item")).alias("part"))
    idle = shorter.join(rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("of_part")), "part").where("of_part >= confidence").select("antecedent")
    kept = rules.join(idle.distinct(), "antecedent", "left_anti")
    listed = kept.select("antecedent", F.posexplode("antecedent").alias("place", "rep")).join(of, "rep").groupBy("antecedent").agg(F.sort_array(F.collect_list(F.struct("place", "members"))).alias("listed"))
    return kept.join(listed.select("antecedent", F.transform("listed", lambda x: x["members"]).alias("members")), "antecedent")


def url_filter(pages: DataFrame, labels: DataFrame, rules=HOST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the confidence of the best mined rule, one row per row of `pages`.

    A page is judged by the longest host rule that fits; else it is blocked if
    a mined rule (label `quality` 0) matches, else allowed. Pages take the
    labels with their id; of several labels for an id the lowest counts, null
    labels and null ids are not learnt from. Null, empty and odd urls have no
    host or tokens, so they are allowed. Without labels nothing is mined.
    """
    host, path = host_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = host_rule(F.col("host"), F.col("path"), rules)
    items = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens(F.col("url"), F.col("host"), F.col("path")))
    seen = cut(parsed.select("page_id", F.xxhash64("url").alias("key_url"), "host", "path", name.alias("rule"), verdict.alias("rule_verdict"), items.alias("items")), "urls")
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    mined = cut(mine(seen.join(label, "page_id").select("items", "quality"), F.col("quality") == 0), "url-mined")
    open_ = seen.where("rule is null")
    index = filed(mined.select("antecedent", "members", "confidence"), open_.select("items", F.lit(1).alias("n")))
    hits = matched(open_.dropDuplicates(["page_id", "key_url"]).select("page_id", "key_url", "items"), index)
    best = hits.groupBy("page_id", "key_url").agg(F.max("confidence").alias("confidence"))
    return join_by(seen, best, ["page_id", "key_url"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.round("confidence", 6).alias("confidence"),
    )
