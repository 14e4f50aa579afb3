"""Claims of projects across feeds: the first claimant owns a project until its claim runs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.sources.store import cut

TTL_SECONDS = 30 * 24 * 60 * 60
#: Fixed value: the reason of posts whose project another post owns.
DUPLICATE = "Duplicate project from another source"


def successors(points: DataFrame, ttl_seconds: int) -> DataFrame:
    """`points` (project_id, ts; distinct) with `next`, the first ts of the project more than the time to live later, null if there is none.

    Points and the ends of their lifetimes are sorted by project and time over
    all tasks, so a project with very many claims lies in several of them. Within
    a task the next point is found by a window, and where there is none the first
    point of the project's next task is it.
    """
    ends = points.select("project_id", (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("t"), F.col("ts").alias("of"))
    both = points.select("project_id", F.col("ts").alias("t"), F.lit(None).cast("timestamp").alias("of")).unionByName(ends)
    dealt = cut(both.repartitionByRange("project_id", "t").withColumn("task", F.spark_partition_id()), "claim-times")
    point = F.when(F.col("of").isNull(), F.col("t"))
    # an end at the very time of a point comes after it, so that only later points follow
    behind = Window.partitionBy("project_id", "task").orderBy("t", F.col("of").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    here = dealt.withColumn("next", F.min(point).over(behind)).where("of is not null")
    firsts = dealt.groupBy("project_id", "task").agg(F.min(point).alias("first"))
    later = Window.partitionBy("project_id").orderBy("task").rowsBetween(1, Window.unboundedFollowing)
    beyond = firsts.select("project_id", "task", F.min("first").over(later).alias("beyond"))
    return here.join(beyond, ["project_id", "task"]).select("project_id", F.col("of").alias("ts"), F.coalesce("next", "beyond").alias("next"))


def claim_owners(claims: DataFrame, ttl_seconds: int = TTL_SECONDS, order: str = "job_uuid") -> DataFrame:
    """The owners of each project, one after the other: project_id, owner, claimed_at.

    Of claims of one time the first by `order` counts. Each point in time points
    to the one that takes over from it; the pointers are doubled round by round
    (one, two, four lifetimes ahead), and each round the owners known so far lead
    to as many more. So there are as many rounds as the logarithm of the longest
    history in lifetimes.
    """
    least = F.min(F.struct(F.col(order).alias("tie"), "job_uuid")).alias("least")
    points = cut(claims.groupBy("project_id", "ts").agg(least).select("project_id", "ts", F.col("least.job_uuid").alias("owner")), "claim-points")
    ahead = cut(successors(points.select("project_id", "ts"), ttl_seconds).where("next is not null"), "claim-pointers")
    owned = cut(points.groupBy("project_id").agg(F.min("ts").alias("ts")), "claim-owners")
    while True:
        more = cut(owned.join(ahead, ["project_id", "ts"]).select("project_id", F.col("next").alias("ts")), "claim-owners")
        if more.isEmpty():
            break
        owned = owned.unionByName(more)
        second = ahead.select("project_id", F.col("ts").alias("next"), F.col("next").alias("after"))
        ahead = cut(ahead.join(second, ["project_id", "next"]).select("project_id", "ts", F.col("after").alias("next")), "claim-pointers")
    return owned.join(points, ["project_id", "ts"]).select("project_id", "owner", F.col("ts").alias("claimed_at"))


def claim_projects(claims: DataFrame, ttl_seconds: int = TTL_SECONDS, order: str = "job_uuid") -> DataFrame:
    """`claims` (project_id, job_uuid, ts, maybe others) with `owner`, `claimed_at` and `claimed`.

    Claims are taken by ts, then by `order`. The owner may claim again, which
    does not renew the claim; another post takes over only when more than the
    time to live has passed since the owner's claim. Claims without project or
    time are left out.
    """
    own = claims.where(F.col("project_id").isNotNull() & F.col("ts").isNotNull())
    terms = claim_owners(own, ttl_seconds, order).groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("claimed_at", "owner"))).alias("terms"))
    joined = own.join(terms, "project_id")
    at = F.element_at(F.filter("terms", lambda t: t["claimed_at"] <= F.col("ts")), -1)
    return joined.withColumn("owner", at["owner"]).withColumn("claimed_at", at["claimed_at"]).drop("terms").withColumn("claimed", F.col("owner").eqNullSafe(F.col("job_uuid")))


def mark_duplicates(decided: DataFrame, claims: DataFrame, key: str = "job_uuid") -> DataFrame:
    """Decided posts whose claim was refused become rejected duplicates; they stay in the table."""
    lost = claims.where("not claimed").select(key).distinct().withColumn("lost", F.lit(True))
    joined = decided.join(lost, key, "left")
    lost_ = F.coalesce("lost", F.lit(False))
    put = {"final_decision": F.lit("Rejected"), "decision_reason": F.lit(DUPLICATE), "category_id": F.lit(None).cast("string"), "notification_status": F.lit(None).cast("string")}
    return joined.withColumns({c: F.when(lost_, v).otherwise(F.col(c)) for c, v in put.items() if c in decided.columns}).drop("lost")

