"""What the operators of this subpackage share: words, row identity, durable intermediate tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.store import cut, spread

__all__ = ["BLANKS", "cut", "join_by", "lowest_hashes", "row_key", "small_side", "table", "words"]

#: What separates words: the blanks of ASCII.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory, on any file system that Spark can read; dealt to all cores if its files make fewer tasks."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart: equal (id, text) rows have equal results, so they may share a key; null is a value."""
    return [F.col(doc_id).alias("key_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key_text")]


def join_by(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Join on `names`, where null equals null; they come from the left."""
    other = right.select(*(F.col(c).alias(f"right_{c}" if c in names else c) for c in right.columns))
    on = functools.reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"right_{n}")) for n in names))
    return left.join(other, on, how).drop(*(f"right_{n}" for n in names))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it was counted to hold at most `rows` rows; otherwise unchanged, for a shuffled join.

    `df` should come from `cut`, so that counting reads only file footers.
    """
    return F.broadcast(df) if df.count() <= rows else df


def lowest_hashes(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most `rows` rows of `df` (a table from `cut`): those with the lowest hash of the columns `by`.

    Rows far above the cut go first, so that few more than `rows` are sorted
    and sent on, however many tasks there are.
    """
    share = 1.2 * (rows + 1000) / max(df.count(), 1)
    rank = F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    near = df.where(rank < int(min(share, 1.0) * (1 << 40))) if share < 1 else df
    return near.orderBy(rank, *by).limit(rows)
