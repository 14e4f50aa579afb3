"""Routing accepted posts to subscribers, and the delivery queue as a table state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import first_nonempty
from sluice.operators.review import guard_gate
from sluice.sources.lexicon import MAX_PROFILES
from sluice.sources.store import bounded

MAX_ATTEMPTS, BATCH, BASE_SECONDS, MAX_SECONDS = 5, 20, 5, 300
#: Subscribers of up to this many rows are broadcast to the posts.
BROADCAST_ROWS = 200_000
#: A category with more posts or subscribers than these is dealt to a grid of parts that have no more of either.
PART_POSTS, PART_TAKERS = 20_000, 2_000


def category_subscribers(users: DataFrame, subscriptions: DataFrame, category_id: str | None = None) -> DataFrame:
    """Active users of each category (or of one)."""
    wanted = subscriptions if category_id is None else subscriptions.where(F.col("category_id") == category_id)
    return users.where("is_active").join(wanted.select("user_id", "category_id").distinct(), "user_id")


def fanout(jobs: DataFrame, users: DataFrame, subscriptions: DataFrame, queue: DataFrame | None = None, guard: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """New queue rows (job_uuid, user_id, category_id, external_id): one for each post with a category and subscriber, without those already queued.

    With a `guard` log only posts that its gate allows are sent on: denied ones,
    and those still to be evaluated, are not. Few categories hold all posts, so
    posts aren't shuffled by category alone: subscribers are broadcast if they were
    counted to be few, else large categories are dealt to parts (`_dealt`). Only
    posts of several categories can reach a user twice, so only their rows are
    made distinct.
    """
    ready = jobs.where(first_nonempty("category_id") != "")
    if guard is not None:
        gated = ready if "reviewed" in ready.columns else ready.withColumn("reviewed", F.lit(False))
        ready = guard_gate(gated, guard).where("gate = 'allow'")
    filed = ready.groupBy("job_uuid").agg(F.collect_set("category_id").alias("categories"))
    takers = category_subscribers(users, subscriptions).select("user_id", "external_id", "category_id").dropDuplicates(["category_id", "user_id"])
    few = takers.count() <= broadcast_rows

    def met(some: DataFrame) -> DataFrame:
        posts = some.select("job_uuid", F.explode("categories").alias("category_id"))
        return posts.join(F.broadcast(takers), "category_id") if few else _dealt(posts, takers)

    many = met(filed.where(F.size("categories") > 1)).dropDuplicates(["job_uuid", "user_id"])
    rows = met(filed.where(F.size("categories") == 1)).unionByName(many)
    return rows if queue is None else rows.join(queue.select("job_uuid", "user_id").distinct(), ["job_uuid", "user_id"], "left_anti")


def _dealt(posts: DataFrame, takers: DataFrame, part_posts: int = PART_POSTS, part_takers: int = PART_TAKERS) -> DataFrame:
    """`posts` with the `takers` of their category; those of large categories meet in a grid of parts.

    A post is sent once for each part of its category's takers and a taker once
    for each part of its posts, so what is shuffled grows with posts, takers and
    a small share of the result. Large categories are at most one for each
    `part_posts` posts and `part_takers` takers, so they are broadcast.
    """
    counted = lambda df, n: df.groupBy("category_id").agg(F.count("*").alias(n))
    sizes = counted(posts, "n_posts").join(counted(takers, "n_takers"), "category_id").where((F.col("n_posts") > part_posts) | (F.col("n_takers") > part_takers))
    grid = F.broadcast(sizes.select("category_id", F.ceil(F.col("n_posts") / part_posts).cast("int").alias("across"), F.ceil(F.col("n_takers") / part_takers).cast("int").alias("down")))
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    left = posts.join(grid, "category_id", "left").select(*posts.columns, F.pmod(F.xxhash64("job_uuid"), one("across")).cast("int").alias("post_part"), every("down").alias("taker_part"))
    right = takers.join(grid, "category_id", "left").select(*takers.columns, every("across").alias("post_part"), F.pmod(F.xxhash64("user_id"), one("down")).cast("int").alias("taker_part"))
    return left.join(right, ["category_id", "post_part", "taker_part"]).drop("post_part", "taker_part")


def fanout_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_uuid").agg(F.count("*").alias("n_queued"))


def claimable(queue: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Rows that may be sent now: pending or failed, attempts left, time come, user active."""
    due = queue.where(F.col("status").isin("Pending", "Failed") & (F.col("attempts") < MAX_ATTEMPTS) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    return due.join(users.where("is_active").select("user_id"), "user_id", "left_semi")


def claim_batch(queue: DataFrame, users: DataFrame, now: Column, limit: int = BATCH) -> DataFrame:
    """The first `limit` claimable rows by insertion, now being sent, one attempt more."""
    first = claimable(queue, users, now).orderBy("seq").limit(limit)
    return first.withColumns({"status": F.lit("Sending"), "attempts": F.col("attempts") + 1, "updated_at": now})


def retry_delay(attempts: Column) -> Column:
    """Seconds to wait after so many attempts."""
    return F.least(F.lit(MAX_SECONDS), (BASE_SECONDS * F.pow(F.lit(2), attempts)).cast("int"))


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after sends (notification_id, outcome, retry_after_s, error); `deactivate` marks users who have blocked the sender."""
    joined = queue.join(outcomes.select("notification_id", "outcome", "retry_after_s", "error"), "notification_id", "left")
    after = lambda seconds: now + F.make_dt_interval(secs=seconds)
    known, ok, limited, blocked = (F.col("outcome").isNotNull(), *(F.col("outcome") == x for x in ("ok", "rate_limited", "forbidden")))
    retry = F.when(F.col("attempts") < MAX_ATTEMPTS, after(retry_delay(F.col("attempts")))).otherwise(F.col("next_attempt_at"))
    return joined.select(
        *(c for c in queue.columns if c not in ("status", "last_error", "next_attempt_at", "updated_at")),
        F.when(ok, "Sent").when(known, "Failed").otherwise(F.col("status")).alias("status"),
        F.when(ok, "").when(known, F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(ok, F.lit(None)).when(limited, after(F.col("retry_after_s"))).when(blocked, F.col("next_attempt_at")).when(known, retry).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(known, now).otherwise(F.col("updated_at")).alias("updated_at"), F.coalesce(blocked, F.lit(False)).alias("deactivate"),
    )


def deactivate_users(users: DataFrame, queue: DataFrame) -> DataFrame:
    """Users without those the queue wants deactivated."""
    off = queue.where("deactivate").select("user_id").distinct().withColumn("off", F.lit(True))
    return users.join(off, "user_id", "left").withColumn("is_active", F.col("is_active") & F.col("off").isNull()).drop("off")


def reset_sending(queue: DataFrame, now: Column) -> DataFrame:
    """After a crash: rows being sent are pending again, due now."""
    stuck = F.col("status") == "Sending"
    return queue.withColumns({"status": F.when(stuck, "Pending").otherwise(F.col("status")), "next_attempt_at": F.when(stuck, now).otherwise(F.col("next_attempt_at"))})


def dead_letters(queue: DataFrame) -> DataFrame:
    """Rows that will never be sent: no attempts left."""
    return queue.where((F.col("attempts") >= MAX_ATTEMPTS) & (F.col("status") != "Sent"))


def subscription_summary(subscriptions: DataFrame, categories: DataFrame) -> DataFrame:
    """A user's enabled categories in the order of selection (`seq` of the subscriptions, if there is one; ties by name)."""
    seq = F.col("seq") if "seq" in subscriptions.columns else F.lit(0)
    once = subscriptions.groupBy("user_id", "category_id").agg(F.min(seq).alias("seq"))
    named = once.join(bounded(categories.where("enabled").select("category_id", "name"), MAX_PROFILES, "categories"), "category_id")
    return named.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("seq", "name"))), lambda x: x["name"]).alias("names"))


def delivery_rows(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue rows with their posts; `problem` tells rows whose post is gone."""
    held = jobs.withColumn("found", F.lit(True))
    return queue.join(held, "job_uuid", "left").withColumn("problem", F.when(F.col("found").isNull(), "Job record not found")).drop("found")


def build_outbox(rows: DataFrame, text: Column) -> DataFrame:
    """What goes out: destination, text and link button of each delivery row without a problem."""
    return rows.where("problem is null").select("notification_id", F.col("external_id").alias("destination"), text.alias("text"), F.nullif("url", F.lit("")).alias("button_url"))
