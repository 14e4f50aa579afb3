"""Line dedup: boilerplate lines are those on many distinct sites.

Only built-in Spark functions. Lines are counted by hash with map-side
combining; a line with too few occurrences, or on one site, can't reach the
threshold and goes no further. The rest get a HyperLogLog sketch of their
sites, merged by aggregation; only lines whose estimate is near the threshold
get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, join_by, row_key, small_side

MIN_SITES = 10
#: Sketches have 2^LOG2_SIZE slots; estimates within this share of the threshold are counted exactly.
LOG2_SIZE = 10
NEAR = 0.25
BROADCAST_ROWS = 500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """Row key, position, site (null is a site) and 96-bit hash (a, b) of every line that has a word."""
    one = docs.select(*row_key(), F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit(""))).alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    return one.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("key_id", "key_text", "pos", "site", F.xxhash64("line").alias("a"), F.hash("line").alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (a, b) and number of sites of the lines on at least `min_sites` distinct sites.

    The number is the sketch's estimate where that is far from the threshold, else exact.
    """
    frequent = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    frequent = frequent.where((F.col("n") >= min_sites) & ((F.col("low") != F.col("high")) | F.lit(min_sites <= 1)))
    some = lines.join(small_side(cut(frequent.select("a", "b"), "lines-frequent"), BROADCAST_ROWS), ["a", "b"], "left_semi")
    sketched = cut(some.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG2_SIZE))).alias("sites")), "lines-sketched")
    sure = sketched.where(F.col("sites") > min_sites * (1 + NEAR))
    near = cut(sketched.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("a", "b"), "lines-near")
    exact = lines.join(small_side(near, BROADCAST_ROWS), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count_distinct("site").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` without cross-site boilerplate; `text` is what is left, `n_lines` and `n_removed` count lines with words.

    A line with words that is on at least `min_sites` sites goes from every
    document but the one with the lowest doc_id (null is lowest; of several
    texts with that id one), where its first occurrence stays. Other lines, blank ones too, stay as they are; a document whose
    lines all go keeps an empty text, a null text stays null. Rows with equal
    id and text are treated alike. Other columns are kept, but for columns of
    the input named n_lines or n_removed, which are replaced.
    """
    own = docs.drop("n_lines", "n_removed")
    lines = cut(line_table(own, site), "lines")
    bad = cut(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(small_side(bad.select("a", "b"), BROADCAST_ROWS), ["a", "b"])
    place = F.struct("key_id", "key_text", "pos")
    first = hits.groupBy("a", "b").agg(F.min(place).alias("first"))
    first = cut(first, "boilerplate-first")
    extra = hits.join(small_side(first, BROADCAST_ROWS), ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    gone = extra.groupBy("key_id", "key_text").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    packed = own.select(F.struct("*").alias("row"), *row_key(), F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"))
    both = join_by(packed, gone, ["key_id", "key_text"])
    line = _lines(F.col("row.text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    done = both.withColumn("lines", F.when(F.col("gone").isNotNull(), line)).select("row", kept.alias("left"), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    # in two steps, so that no column of the row is taken for one of ours
    return done.select(*(F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in own.columns), "n_lines", "n_removed")


ORACLE = f"""
WITH line AS (
  SELECT doc_id, source, u.pos AS pos, u.line AS line FROM (
    SELECT doc_id, source, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'pos': i, 'line': x}})) AS u FROM documents)
), bad AS (
  SELECT line FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), mark AS (
  SELECT l.*, b.line IS NOT NULL AS is_bad, row_number() OVER (PARTITION BY l.line ORDER BY doc_id, pos) AS k FROM line l LEFT JOIN bad b ON l.line = b.line
)
SELECT doc_id, sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END)::BIGINT AS n_lines,
  sum(CASE WHEN is_bad AND k > 1 THEN 1 ELSE 0 END)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_bad OR k = 1), '')) AS kept_sha256
FROM mark GROUP BY doc_id
"""
