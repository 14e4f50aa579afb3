"""Streams: triage in micro-batches, exact de-duplication, claims as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from sluice.functions.identity import job_uuid, project_id
from sluice.operators.claims import TTL_SECONDS, claim_projects, mark_duplicates
from sluice.operators.decide import classify_all, final_decision, select_category
from sluice.operators.parse import parse_posts
from sluice.sources.store import cut, scratch
from sluice.streaming import BUCKETS, bucket, rocksdb_state


#: How far posts of a stream may be out of order before the time of their arrival counts as theirs.
CLAIM_DELAY = "1 day"


def parsed(posts: DataFrame) -> DataFrame:
    """Posts with what the later steps need: title, description, url, project_id."""
    timed = ["ts"] if "ts" in posts.columns else []
    jobs = parse_posts(posts).withColumn("project_id", project_id(F.col("url")))
    return jobs.select("job_uuid", "identity", "job_id", "source", "title", "url", *timed, *(["project_id"] if timed else []), "description")


def decided(jobs: DataFrame, profiles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Decisions for parsed posts."""
    results = cut(classify_all(jobs.select("job_uuid", "title", "description"), profiles, lexicon), "classified")
    return jobs.drop("description").join(final_decision(results, select_category(results), jobs=jobs), "job_uuid")


def triage(posts: DataFrame, profiles: DataFrame, lexicon: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Decisions for `posts` (identity, job_id, source, text, maybe ts): parse, identify, classify, select, claim.

    With `ts`, posts claim the project that their link names, by ts; posts of a
    project that another post owns are kept, rejected as duplicates.
    """
    named = posts.withColumn("job_uuid", job_uuid(F.col("identity"), F.col("job_id"))).dropDuplicates(["job_uuid"])
    jobs = cut(parsed(named), "parsed")
    found = decided(jobs, profiles, lexicon)
    return mark_duplicates(found, claim_projects(jobs.select("project_id", "job_uuid", "ts"), ttl_seconds)) if "ts" in posts.columns else found


def triage_batch(profiles: DataFrame, lexicon: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Writer of a micro-batch of parsed posts, with `claimed` if they have times: it goes to a partition of its own, so that a batch run again replaces itself.

    The batch is computed once; the tables cut for it go when it is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            jobs = cut(batch, "batch")
            if jobs.isEmpty():  # a batch that only moves the watermark
                return
            found = decided(jobs.drop("claimed"), profiles, lexicon)
            if "claimed" in jobs.columns:
                found = mark_duplicates(found, jobs.where("project_id is not null").select("job_uuid", "claimed"))
            found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_stream(
    posts: DataFrame, profiles: DataFrame, lexicon: DataFrame, path: str, checkpoint: str, delay: str | None = None, ttl_seconds: int = TTL_SECONDS, claim_delay: str = CLAIM_DELAY
) -> StreamingQuery:
    """Triage of a stream of posts, all that is there, batch by batch; with `ts` posts claim projects as `claim_stream` says.

    Posts that came before are left out by keyed state, so a batch costs no more
    as the output grows. With a `delay` that state is bounded: a post is told
    from those at most so much older by `ts`.
    """
    named = posts.withColumn("job_uuid", job_uuid(F.col("identity"), F.col("job_id")))
    jobs = parsed(named.dropDuplicates(["job_uuid"]) if delay is None else dedup_stream(named, delay))
    if "ts" in posts.columns:
        jobs = claim_stream(jobs, ttl_seconds, claim_delay if delay is None else None)
    writer = jobs.writeStream.foreachBatch(triage_batch(profiles, lexicon, path))
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocksdb_state(posts.sparkSession):
        return writer.start()


def dedup_stream(jobs: DataFrame, delay: str = "1 day", time: str = "ts") -> DataFrame:
    """Each post of a stream once, with state bounded by the delay."""
    return jobs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["job_uuid"])


class Claims(StatefulProcessor):
    """Who owns the projects of a bucket, in order of arrival; the rows of one batch arrive by time, then id.

    The state holds the projects whose claim is alive, in one value with one
    timer: for the claim that runs out next. Claims whose end the watermark has
    passed go. A bucket's rows of one batch are held at once, so the trigger
    bounds them.
    """

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claims", "timer_ms long, projects array<string>, owners array<string>, since_ms array<long>")

    def load(self) -> None:
        self.timer, *columns = self.state.get() if self.state.exists() else (None, [], [], [])
        self.claims = {project: (owner, since) for project, owner, since in zip(*columns, strict=True)}

    def save(self, watermark: int) -> None:
        rows = [(project, owner, since) for project, (owner, since) in self.claims.items() if since + self.ttl >= watermark]
        first = min((since for _, _, since in rows), default=None)
        first = None if first is None else first + self.ttl + 1
        if self.timer != first:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if first is not None:
                self.handle.registerTimer(first)
        if rows:
            self.state.update((first, *([r[k] for r in rows] for k in range(3))))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "job_uuid"])
        arrived = max(timerValues.getCurrentWatermarkInMs(), 0)
        claimed = []
        for project, uuid, ts in zip(batch["claim_key"].tolist(), batch["job_uuid"].tolist(), batch["ts_ms"].tolist(), strict=True):
            if project is None:
                claimed.append(True)
                continue
            now = max(ts, arrived)
            owner, since = self.claims.get(project, (None, None))
            if owner is None or now > since + self.ttl:
                owner, since = self.claims[project] = uuid, now
            claimed.append(owner == uuid)
        self.save(arrived)
        yield batch.assign(claimed=claimed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.timer = None  # this one has gone off
        self.save(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        yield from ()

    def close(self) -> None:
        pass


#: How columns go through pandas that it can't hold: times outside of 1677 to 2262, and whole numbers of 17 digits beside nulls.
TO_TEXT = {"timestamp": lambda c: F.unix_micros(c).cast("string"), "bigint": lambda c: F.col(c).cast("string")}
FROM_TEXT = {"timestamp": lambda c: F.timestamp_micros(F.col(c).cast("long")), "bigint": lambda c: F.col(c).cast("long")}


def claim_stream(claims: DataFrame, ttl_seconds: int = TTL_SECONDS, delay: str | None = CLAIM_DELAY, buckets: int = BUCKETS) -> DataFrame:
    """`claims` (project_id, job_uuid, ts, maybe others) of a stream with `claimed`; needs the RocksDB state store (`rocksdb_state`).

    The first to arrive owns a project, whatever its ts. A claim's time is its
    ts, but never before the watermark, which follows the latest ts by `delay`;
    so a post that comes late never owns what another holds, nor takes over with
    a time gone by. Another post takes over when more than the time to live has
    passed between the two times, and the state of a claim is deleted when the
    watermark has passed that end, which changes no result. No row is dropped for
    being late. Rows without project are claimed; rows without ts count as
    arriving now. `delay` None: the rows have a watermark already. Projects are
    kept by `buckets` (see `sluice.streaming`).
    """
    timed = claims if delay is None else claims.withColumn("clock", F.col("ts")).withWatermark("clock", delay).drop("clock")
    text = {c: kind for c, kind in claims.dtypes if kind in TO_TEXT}
    added = {"claim_key": F.col("project_id").cast("string"), "ts_ms": F.coalesce(F.unix_millis("ts"), F.lit(0)), "bucket": bucket(F.coalesce("project_id", "job_uuid"), buckets)}
    # as text, ts carries no watermark that would drop late rows
    keyed = timed.withColumns(added).withColumns({c: TO_TEXT[kind](c) for c, kind in text.items()})
    schema = StructType([*keyed.schema.fields, StructField("claimed", BooleanType())])
    marked = keyed.groupBy("bucket").transformWithStateInPandas(Claims(ttl_seconds), schema, "append", "eventTime")
    return marked.withColumns({c: FROM_TEXT[kind](c) for c, kind in text.items()}).drop(*added)
