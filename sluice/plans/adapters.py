"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.parse import parse_posts
from sluice.sources.lexicon import PROSE, compile_lexicon, lexicon_table, prose_profiles
from sluice.sources.store import cut, spread

#: Tables of long texts, which are dealt to all cores.
TEXTS = ("documents", "conversations", "pages")
#: What "now" is for tables of the past.
NOW = "timestamp'2024-02-01 00:00:00'"
ORDERS_NOW = "timestamp'1998-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts of channels: the source is the channel."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("identity"), F.col("doc_id").cast("string").alias("job_id"), "source", "text", "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a second feed."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("identity"), F.col("turn").cast("string").alias("job_id"), F.col("role").alias("source"), "text")


def jobs(spark: SparkSession, sf_dir: str, paragraphs: bool = True) -> DataFrame:
    """doc_id, title and description of documents; without `paragraphs` for their words only."""
    return parse_posts(posts(spark, sf_dir), paragraphs=paragraphs).select("doc_id", "title", "description")


@functools.cache
def profiles(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Profiles and compiled lexicon for the driver's prose, compiled once for a session."""
    return prose_profiles(spark), cut(compile_lexicon(lexicon_table(spark, PROSE)), "lexicon", keep=True)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages of chats; errors are failures."""
    return events(spark, sf_dir).select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("msg_id"), (F.col("event_type") != "error").alias("ok"), "ts")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as users; those in the black are active."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("external_id"), (F.col("c_acctbal") >= 0).alias("is_active"), "c_nationkey", "c_mktsegment")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three users with neighbouring numbers subscribe to the category of each other's orders."""
    return users(spark, sf_dir).select("user_id", F.floor(F.col("user_id") / 3).cast("string").alias("category_id"))


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as accepted posts; the category goes by the customer, some have none."""
    group = F.floor(F.col("o_custkey") / 3).cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_uuid"), F.when(F.col("o_orderstatus") != "P", group).alias("category_id"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a delivery queue."""
    status = F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderkey") % 3 == 0, "Sending").when(F.col("o_orderstatus") == "F", "Failed").otherwise("Sent")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("notification_id"), F.col("o_orderkey").alias("job_uuid"), F.col("o_custkey").alias("user_id"), status.alias("status"),
        (F.col("o_orderkey") % 6).cast("int").alias("attempts"), F.lit("").alias("last_error"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("next_attempt_at"), F.col("o_orderdate").alias("updated_at"),
    )


def guard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a log of guard decisions; two entries for some documents."""
    said = F.when(F.col("toxic") == 1, "do_not_notify").when(F.col("quality") == 1, "notify").otherwise("error")
    one = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_uuid"), F.col("doc_id").alias("seq"), said.alias("guard_decision"))
    again = one.where("job_uuid % 3 = 0").select("job_uuid", (F.col("seq") + 1_000_000_000).alias("seq"), F.when(F.col("guard_decision") == "error", "notify").otherwise("error").alias("guard_decision"))
    return one.unionByName(again)
