"""Reading feeds: backlogs by watermark, paged feeds, what has been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

MESSAGES = "chat_id long, chat_title string, msg_id long, ts timestamp, text string, buttons array<array<struct<url:string>>>"
PROJECTS = "poll_source string, uid string, platform string, title string, description string, price string, project_link string, posted_rank long"
MAX_PAGES, PAGE_SIZE, BACKLOG = 10, 30, 2000


def read_messages(spark: SparkSession, path: str, channels: list[int] | None = None, stream: bool = False, schema: str | StructType = MESSAGES) -> DataFrame:
    """Messages of a landing folder of JSON files, as a table or as a stream; only of `channels` if given."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    found = reader.json(path)
    return found if channels is None else found.where(F.col("chat_id").isin(channels))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECTS).json(path)


def channel_backlog(messages: DataFrame, watermark: DataFrame, limit: int = BACKLOG) -> DataFrame:
    """Per chat the first `limit` messages above its watermark (chat_id, last_id), oldest first; chats without one have no backlog.

    The rank filter reaches the map side, so a busy chat sends at most `limit` rows from each task.
    """
    above = messages.join(watermark.select("chat_id", "last_id"), "chat_id").where(F.col("msg_id") > F.col("last_id"))
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy("msg_id"))
    return above.withColumn("backlog_rank", rank).where(F.col("backlog_rank") <= limit).drop("last_id")


def seed_watermarks(messages: DataFrame, watermark: DataFrame) -> DataFrame:
    """Watermarks with the newest id for chats that had none."""
    newest = messages.groupBy("chat_id").agg(F.max("msg_id").alias("last_id"))
    return watermark.select("chat_id", "last_id").unionByName(newest.join(watermark, "chat_id", "left_anti"))


def advance_watermark(results: DataFrame, watermark: DataFrame) -> DataFrame:
    """Watermarks after some `results` (chat_id, msg_id, ok): the highest id below the first failure, never lower than before."""
    marked = results.join(watermark.select("chat_id", "last_id"), "chat_id", "left").where(F.col("msg_id") > F.coalesce("last_id", F.lit(0)))
    failed = marked.where("not ok").groupBy("chat_id").agg(F.min("msg_id").alias("bad"))
    done = marked.where("ok").join(failed, "chat_id", "left").where(F.col("bad").isNull() | (F.col("msg_id") < F.col("bad")))
    new = done.groupBy("chat_id").agg(F.max("msg_id").alias("new_id"))
    every = watermark.select("chat_id").unionByName(results.select("chat_id")).distinct()
    return every.join(watermark, "chat_id", "left").join(new, "chat_id", "left").select("chat_id", F.greatest("new_id", F.coalesce("last_id", F.lit(0))).alias("last_id"))


def paged_feed(projects: DataFrame, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES, source: str = "poll_source", newest: str = "posted_rank") -> DataFrame:
    """The first pages of each source, newest first (lowest `newest`)."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(newest, "uid"))
    ranked = projects.withColumn("feed_rank", rank).where(F.col("feed_rank") <= page_size * max_pages)
    return ranked.withColumn("page", F.floor((F.col("feed_rank") - 1) / page_size).cast("int") + 1)


def feed_catchup(pages: DataFrame, seen: DataFrame, max_pages: int = MAX_PAGES, source: str = "poll_source") -> DataFrame:
    """New projects since the last poll: pages are walked while all is unseen, up to the first with a seen id or the last allowed.

    A source never polled before is only seeded: nothing of it is new. Rows come
    with `arrival`, oldest first; an id on several pages counts at its oldest place.
    """
    known = seen.select(F.col(source), "uid").distinct().withColumn("seen", F.lit(True))
    joined = pages.join(known, [source, "uid"], "left")
    stop = joined.where("seen").groupBy(source).agg(F.min("page").alias("stop"))
    new = joined.where("seen is null").join(known.select(source).distinct(), source, "left_semi").join(stop, source, "left")
    walked = new.where(F.col("page") <= F.least(F.coalesce("stop", F.lit(max_pages)), F.lit(max_pages)))
    once = walked.groupBy(source, "uid").agg(F.max("feed_rank").alias("feed_rank"), F.max("page").alias("page"))
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.col("feed_rank").desc(), "uid"))
    return once.withColumn("arrival", rank)


def mark_seen(seen: DataFrame, processed: DataFrame, source: str = "poll_source") -> DataFrame:
    """Seen ids (source, uid, seen_seq) with those processed successfully (source, uid, ok, seen_seq)."""
    fresh = processed.where("ok").select(source, "uid", "seen_seq").dropDuplicates([source, "uid"])
    return seen.select(source, "uid", "seen_seq").unionByName(fresh.join(seen, [source, "uid"], "left_anti"))


def trim_seen(seen: DataFrame, page_size: int = PAGE_SIZE, source: str = "poll_source") -> DataFrame:
    """The ids inserted last: max(500, 10 pages) for each source."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.col("seen_seq").desc(), F.col("uid").desc()))
    return seen.withColumn("rank", rank).where(F.col("rank") <= max(500, 10 * page_size)).drop("rank")
