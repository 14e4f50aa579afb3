"""Benchmark decontamination by a distributed positional inverted index.

Only built-in Spark functions. Documents are cut into words once. By document
frequency over the whole corpus each window of test words picks its three
rarest terms; postings (term, document, position) are stored for those terms
only. The rarest term's postings, shifted by its offset, give the places where
a window may start; a place stays if the postings of the second and third
rarest terms hold the positions that it asks for. What is left is compared word
by word.

For proximity matches a window is cut in one stretch more than words that may
differ, so that one of them is whole in any match. Postings of stretches give
the places where a window is compared with the words around by edit distance.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import cut, join_by, row_key, small_side

WINDOW = 10
#: Words that may be put in, left out or changed in a proximity match of a window of ten; shorter windows have less.
SLOP = 2
SLOP_WORDS = 5
#: Windows up to this many are broadcast to the postings; of more, those of each term are dealt to so many parts.
BROADCAST_ROWS, PARTS = 200_000, 16
#: What parts terms in a text as it is, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Words of a text: runs of digits, letters (A-Z lower-cased) and anything beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of `items` (item_id, text): `window` (number), `w` (words) and the item_ids that have it, with their number."""
    w = items.select("item_id", terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("w"))
    return each.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(F.xxhash64("w").alias("window"), "w", "items", F.xxhash64("items").alias("item_set"))


def anchored(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Windows under the number of their rarest `term`: its offset `at`, and numbers and relative places of the next two (t2, d2, t3, d3).

    A window with a term that no document has can't occur and is left out.
    """
    ranked = windows.select("window", F.posexplode("w").alias("at", "term")).join(frequency, "term", "left").groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "at"))).alias("all")
    )
    one = ranked.select("window", F.filter("all", lambda x, i: (i == 0) | (x["term"] != F.get("all", i - 1)["term"])).alias("one"))
    a = F.get("one", 0)
    b = F.coalesce(F.get("one", 1), a)
    c = F.coalesce(F.get("one", 2), b)
    number = lambda x: F.xxhash64(x["term"])
    return one.where(a["df"] > 0).select(
        "window", number(a).alias("term"), a["at"].alias("at"), number(b).alias("t2"), (b["at"] - a["at"]).alias("d2"), number(c).alias("t3"), (c["at"] - a["at"]).alias("d3")
    )


def _met(postings: DataFrame, filed: DataFrame, by: str) -> DataFrame:
    """`postings` with the rows of `filed` under the same `by`."""
    if filed.count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(filed), by)
    part = F.pmod(F.xxhash64("key_id", "key_text", "pos"), F.lit(PARTS)).cast("int")  # a term may be very frequent
    dealt = filed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return postings.withColumn("part", part).join(dealt, [by, "part"]).drop("part")


def _holding(places: DataFrame, postings: DataFrame, term: str, apart: str) -> DataFrame:
    """The `places` with the term in column `term` at its distance `apart`."""
    other = postings.select(F.col("key_id").alias("k"), F.col("key_text").alias("t"), F.col("term").alias("other"), F.col("pos").alias("other_pos"))
    on = F.col("key_id").eqNullSafe(F.col("k")) & (F.col("key_text") == F.col("t")) & (F.col(term) == F.col("other")) & (F.col("pos") + F.col(apart) == F.col("other_pos"))
    return places.join(other, on, "left_semi")


def _edits(size: Column, slop: int) -> Column:
    """Words that may differ in a proximity match of a window of `size` words."""
    return F.least(F.lit(slop), F.floor(size / SLOP_WORDS).cast("int"))


def stretches(windows: DataFrame, slop: int) -> DataFrame:
    """Windows cut in one stretch more than edits they may have: number `phrase`, words in it `long`, the stretch's place `shift`.

    So many edits leave one stretch whole. Windows that may have none are left out.
    """
    edits = _edits(F.size("w"), slop)
    of = windows.where(edits > 0).withColumn("long", F.floor(F.size("w") / (edits + 1)).cast("int"))
    each = of.withColumn("shift", F.explode(F.transform(F.sequence(F.lit(0), edits), lambda k: k * F.col("long"))))
    return each.select(F.xxhash64(F.slice("w", F.col("shift") + 1, F.col("long"))).alias("phrase"), "long", "shift", "window")


def _near(windows: DataFrame, texts: DataFrame, slop: int, most: int) -> DataFrame:
    """Proximity matches (key_id, key_text, window, item_set, at, size): texts that hold a stretch of a window are compared with it there.

    A place is a run of neighbouring first words from which few enough edits
    make the window; `at` is the one that takes the fewest, the first of those.
    """
    key = ["key_id", "key_text"]
    filed = cut(stretches(windows, slop), "stretches")
    phrases = cut(filed.select("phrase", "long").distinct(), "stretch-phrases")
    longs = sorted(r["long"] for r in phrases.select("long").distinct().collect())  # as many as there are sizes up to the window's
    whole = texts.where("words <> ''")
    # outer, as an inner explode would split the words once more to filter them
    each = whole.select(*key, F.split("words", " ").alias("w")).select(*key, "w", F.posexplode_outer("w").alias("pos", "first"))
    grams = [F.xxhash64(F.slice("w", F.col("pos") + 1, n)) for n in longs] or [F.lit(None).cast("long")]
    said = each.select(*key, "pos", (F.explode(F.array(*grams)) if len(grams) > 1 else grams[0]).alias("phrase"))
    met = cut(said.join(small_side(phrases.select("phrase").distinct(), BROADCAST_ROWS), "phrase", "left_semi"), "stretch-postings")
    held = cut(met.groupBy(*key).agg(F.collect_set(F.struct("pos", "phrase")).alias("met")), "stretch-texts")
    back, ahead = most + slop, most + 2 * slop  # the furthest that a match may begin before a stretch, and end after it
    around = lambda w: F.transform("met", lambda m: F.struct(m["pos"].alias("pos"), m["phrase"].alias("phrase"), F.slice(w, F.greatest(m["pos"] - back, F.lit(0)) + 1, F.lit(back + ahead)).alias("around")))
    placed = join_by(whole, small_side(held, BROADCAST_ROWS), key, "inner").select(*key, F.inline(F.get(F.transform(F.array(F.split("words", " ")), around), 0)))
    letters = F.lit("-" + string.ascii_letters[:most])
    spelt = lambda words: F.array_join(F.transform(words, lambda x: F.substring(letters, F.array_position("w", x).cast("int") + 1, F.lit(1))), "")
    full = small_side(cut(filed.join(windows.select("window", "w", "item_set"), "window"), "stretch-windows"), BROADCAST_ROWS)
    edits = _edits(F.size("w"), slop)
    # words of the window that are gone altogether need an edit each
    both = placed.join(full, "phrase").where(F.size(F.array_except("w", "around")) <= edits)
    compared = both.select(
        *key, "window", "item_set", F.size("w").alias("size"), edits.alias("edits"), (F.col("pos") - F.col("shift")).alias("start"),
        F.greatest(F.col("pos") - back, F.lit(0)).alias("low"), spelt(F.col("w")).alias("a"), spelt(F.col("around")).alias("b"),
    ).withColumn("at", F.explode(F.sequence(F.col("start") - F.col("edits"), F.col("start") + F.col("edits")))).where("at >= 0")
    # words become letters, so that the distance of strings is that of the word lists
    cost = F.array_min(F.transform(F.sequence(F.col("size") - F.col("edits"), F.col("size") + F.col("edits")), lambda n: F.levenshtein(F.col("a"), F.substring(F.col("b"), F.col("at") - F.col("low") + 1, n))))
    found = compared.withColumn("cost", cost).where("cost <= edits").groupBy(*key, "window", "item_set", "size", "at").agg(F.min("cost").alias("cost"))
    run = F.col("at") - F.row_number().over(Window.partitionBy(*key, "window").orderBy("at"))
    best = found.withColumn("run", run).groupBy(*key, "window", "item_set", "size", "run").agg(F.min(F.struct("cost", "at")).alias("best"))
    return cut(best.select(*key, "window", "item_set", F.col("best.at").alias("at"), "size"), "near")


def positional_index(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of each row as one string, the filed windows, and the postings of their terms, all stored."""
    texts = cut(docs.select(*row_key(), F.array_join(terms(F.col("text")), " ").alias("words")), "terms")
    vocabulary = cut(windows.select(F.explode("w").alias("term")).distinct(), "test-terms")
    each = texts.where("words <> ''").select(F.explode(F.array_distinct(F.split("words", " "))).alias("term"))
    frequency = cut(each.join(small_side(vocabulary, BROADCAST_ROWS), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), "test-term-df")
    filed = cut(anchored(windows, frequency), "test-anchors")
    wanted = cut(filed.select(F.explode(F.array("term", "t2", "t3")).alias("term")).distinct(), "anchor-terms")
    placed = texts.where("words <> ''").select("key_id", "key_text", F.posexplode(F.split("words", " ")).alias("pos", "word")).select("key_id", "key_text", "pos", F.xxhash64("word").alias("term"))
    return texts, filed, cut(placed.join(small_side(wanted, BROADCAST_ROWS), "term", "left_semi").distinct(), "postings")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """`docs` with what they share with test `items` (item_id, text).

    n_words; n_hit, the words inside any occurrence of a test window; items,
    the ids of items with occurring windows (none: empty); hits, those places as
    `at` (first word, from 0) and `size`. With `slop` also proximity matches of
    windows whose phrase isn't in the row: stretches of words that are made the
    window by putting in, leaving out or changing one word for each SLOP_WORDS
    of the window, at most `slop`. None is missed.
    They come as n_near (number of windows), near_items (ids) and near (places
    as `at`, the first word of the closest stretch there, and `size`). An item with fewer words than `size` is one window; null and empty texts and
    items have no words, items without id are left out. Equal rows get equal
    results; an empty table on either side gives no hits. Columns of `docs` with
    the names of the results are replaced.
    """
    own = docs.drop("n_words", "n_hit", "items", "hits", "n_near", "near_items", "near")
    key = ["key_id", "key_text"]
    windows = cut(test_windows(items.where(F.col("item_id").isNotNull()), size), "test-windows")
    texts, filed, postings = positional_index(own, windows)
    begun = _met(postings, filed, "term").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0").select(*key, "pos", "window", "start", "t2", "d2", "t3", "d3")
    all3 = cut(_holding(_holding(begun, postings, "t2", "d2"), postings, "t3", "d3").select(*key, "window", "start"), "places")
    phrase = F.struct("start", F.array_join("w", " ").alias("words"), F.size("w").alias("size"), "item_set", "window")
    maybe = cut(all3.join(small_side(windows, BROADCAST_ROWS), "window").groupBy(*key).agg(F.collect_set(phrase).alias("maybe")), "candidates")
    met = join_by(join_by(texts, small_side(maybe.select(*key), BROADCAST_ROWS), key, "left_semi"), maybe, key, "inner").withColumn("w", F.split("words", " "))
    place = lambda h: F.struct(h["start"].alias("at"), h["size"].alias("size"), h["item_set"].alias("item_set"), h["window"].alias("window"))
    hits = F.filter("maybe", lambda h: F.array_join(F.slice("w", h["start"] + 1, h["size"]), " ") == h["words"])
    checked = cut(met.select(*key, F.array_sort(F.transform(hits, place)).alias("hits")), "hits").dropDuplicates(key)
    found = checked.where(F.size("hits") > 0)
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["at"] + s["size"] - F.greatest(s["at"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["at"] + s["size"]).alias("to")),
    )["n"]
    sets = windows.groupBy("item_set").agg(F.first("items").alias("items"))
    named = found.select(*key, F.explode(F.array_distinct(F.col("hits.item_set"))).alias("item_set")).join(sets, "item_set").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    spans = F.array_distinct(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["size"].alias("size"))))
    result = join_by(found.select(*key, spans.alias("hits"), covered.cast("long").alias("n_hit")), named, key)
    packed = own.select(F.struct("*").alias("row"), *row_key(), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "")).cast("long").alias("n_words"))
    out = join_by(packed, result, key)
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    ids = items.schema["item_id"].dataType.simpleString()
    # in two steps, so that no column of the row is taken for one of ours
    unpacked = lambda df: df.select("row.*", *df.columns[1:])
    columns = ["row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("items", ids), none("hits", "struct<at:int,size:int>")]
    if not slop:
        return unpacked(out.select(*columns))
    exact = found.select(*key, F.explode("hits.window").alias("window")).distinct()
    loose = join_by(_near(windows, texts, slop, size), exact, [*key, "window"], "left_anti")
    near = loose.join(sets, "item_set").groupBy(*key).agg(
        F.countDistinct("window").alias("n_near"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("near_items"),
        F.array_sort(F.collect_set(F.struct(F.col("at").cast("int").alias("at"), F.col("size").cast("int").alias("size")))).alias("near"),
    )
    return unpacked(join_by(out, near, key).select(*columns, F.coalesce("n_near", F.lit(0)).alias("n_near"), none("near_items", ids), none("near", "struct<at:int,size:int>")))


ORACLE = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS t
  FROM (SELECT doc_id, w, s.size AS size, unnest(range(1, len(w) - s.size + 2)) AS pos FROM doc, (SELECT DISTINCT size FROM win) AS s)
), hit AS MATERIALIZED (
  SELECT p.doc_id, p.pos, p.size, p.t, i.item_id FROM place p JOIN win i ON p.size = i.size AND p.t = i.t
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS k FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
), test AS MATERIALIZED (
  SELECT t, string_split(t, ' ') AS v, len(string_split(t, ' ')) AS n, least({SLOP}, len(string_split(t, ' ')) // {SLOP_WORDS}) AS e FROM (SELECT DISTINCT t FROM win)
), test_pair AS (
  SELECT t, n, e, k, v[k + 1] || ' ' || v[k + 2] AS g FROM (SELECT *, unnest(range(0, n - 1)) AS k FROM test WHERE e > 0)
), pair AS (
  SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS p FROM doc)
), begun AS MATERIALIZED (
  SELECT doc_id, t, s FROM (SELECT doc_id, t, n, e, k, unnest(range(p - k - e, p - k + e + 1)) AS s FROM pair JOIN test_pair USING (g))
  WHERE s >= 0 GROUP BY doc_id, t, s HAVING count(DISTINCT k) >= any_value(n - 1 - 2 * e)
), spelt AS MATERIALIZED (
  SELECT t, s, doc_id, n, e, array_to_string(list_transform(v, lambda x: substr('-{string.ascii_letters[:WINDOW]}', coalesce(list_position(v, x), 0)::INTEGER + 1, 1)), '') AS a,
    array_to_string(list_transform(w[s + 1:s + n + e], lambda x: substr('-{string.ascii_letters[:WINDOW]}', coalesce(list_position(v, x), 0)::INTEGER + 1, 1)), '') AS b
  FROM begun JOIN test USING (t) JOIN doc USING (doc_id)
), fits AS MATERIALIZED (
  SELECT t, s, doc_id, n, min(levenshtein(a, substr(b, 1, l))) AS cost FROM (SELECT *, unnest(range(n - e, n + e + 1)) AS l FROM spelt)
  GROUP BY t, s, doc_id, n, e HAVING min(levenshtein(a, substr(b, 1, l))) <= e
), near AS MATERIALIZED (
  SELECT t, doc_id, n, arg_min(s, (cost, s)) AS s FROM (SELECT *, s - row_number() OVER (PARTITION BY doc_id, t ORDER BY s) AS run FROM fits)
  WHERE (doc_id, t) NOT IN (SELECT doc_id, t FROM hit) GROUP BY t, doc_id, n, run
), nearby AS (
  SELECT doc_id, count(DISTINCT t) AS n FROM near GROUP BY doc_id
), near_named AS (
  SELECT doc_id, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM near JOIN win USING (t)) GROUP BY doc_id
), near_placed AS (
  SELECT doc_id, string_agg(s || ':' || n, ',' ORDER BY s, n) AS placed FROM (SELECT DISTINCT doc_id, s, n FROM near) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated, coalesce(b.n, 0)::BIGINT AS n_near, coalesce(i.ids, '') AS near_items, coalesce(p.placed, '') AS near
FROM doc d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id LEFT JOIN nearby b ON b.doc_id = d.doc_id LEFT JOIN near_named i ON i.doc_id = d.doc_id LEFT JOIN near_placed p ON p.doc_id = d.doc_id
"""
