"""Queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import identity, render, text
from sluice.operators import audit, claims, decide, match, parse, review, route
from sluice.plans import adapters as a
from sluice.plans import sql
from sluice.sources import feeds
from sluice.sources.keyed import KeyedTable
from sluice.sources.lexicon import MAX_ROWS, compile_lexicon
from sluice.sources.lexicon import lexicon_conflicts as lexicon_conflicts_of
from sluice.sources.store import bounded, cut, shared_dir
from sluice.streaming import catchup, channels, delivery, rocksdb_state, stream, sweep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(twin: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text, so that results compare by value."""
    return df.select(*(F.array_join(c, ", ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes))


def _run_stateful(changes: DataFrame, home: str) -> None:
    """Runs the stream `changes`, of stateful processors, to its end, into the folder `out`."""
    with rocksdb_state(changes.sparkSession):
        changes.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").option("path", f"{home}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.classify_all(a.jobs(spark, sf_dir, paragraphs=False), *a.profiles(spark), key="doc_id")


# --- text and identity


@query(sql.NORMALIZED)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.normalize_text(F.col("text"))
    return a.table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm, 256).alias("norm_sha256"), F.length(norm).cast("long").alias("n_chars"))


@query(sql.PARSED)
def parse_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_posts(a.posts(spark, sf_dir)).select("doc_id", "title", F.sha2("description", 256).alias("description_sha256"), "budget", "url")


@query("""SELECT page_id, url, nullif(regexp_extract(url, '/(?:en|de|fr|es)/([0-9]+)', 1), '') AS project FROM pages""")
def extract_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link is found again in a sentence that brackets it."""
    said = F.concat(F.lit("see (this): ("), F.col("url"), F.lit(")."))
    return a.table(spark, sf_dir, "pages").select("page_id", text.extract_url(said).alias("url"), identity.project_id(F.col("url"), r"/(?:en|de|fr|es)/(\d+)").alias("project"))


@query(sql.JOB_UUID)
def job_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.posts(spark, sf_dir).select("doc_id", identity.job_uuid(F.col("identity"), F.col("job_id")).alias("job_uuid"))


@query("""SELECT doc_id, contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' of the ') AS found FROM documents""")
def contains_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "documents").select("doc_id", text.contains_keyword(text.normalize_text(F.col("text")), F.lit("of the")).alias("found"))


@query("""SELECT source AS identity, doc_id::VARCHAR AS job_id, source, sha256(coalesce(text, '')) AS text_sha256 FROM documents
UNION ALL SELECT conv_id::VARCHAR, turn::VARCHAR, role, sha256(coalesce(text, '')) FROM conversations""")
def unify_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = parse.unify_feeds(a.posts(spark, sf_dir), a.turns(spark, sf_dir))
    return both.select("identity", "job_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query(sql.LABELLED)
def parse_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the labelled layout; some lack a label."""
    labels, k = parse.ARABIC, F.col("doc_id") % 4
    said = F.concat(
        F.when(k == 1, "").otherwise(F.concat(F.lit(f"{labels.title} : Post "), F.col("doc_id"))), F.lit(f"\n{labels.description}: "), F.coalesce("text", F.lit("")),
        F.when(k == 2, "").otherwise(F.concat(F.lit(f"\n{labels.budget}:  "), F.col("doc_id"), F.lit(" \nend"))),
    )
    posts = a.table(spark, sf_dir, "documents").select("doc_id", F.lit("A Labelled feed").alias("source"), said.alias("text"))
    return parse.parse_posts(posts).select("doc_id", "title", F.sha2("description", 256).alias("description_sha256"), "budget")


@query("""SELECT split_part(url, ':', 1) AS identity, page_id::VARCHAR AS job_id, CASE WHEN page_id % 3 = 0 THEN 'Paid' ELSE 'Feed' END AS source, 'T' || page_id AS title, sha256(coalesce(html, '')) AS description_sha256,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE '10' END AS budget, url, sha256('T' || page_id || chr(10) || chr(10) || coalesce(html, '')) AS raw_sha256 FROM pages""")
def feed_to_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as projects of a feed; some lack platform and price."""
    k = F.col("page_id")
    projects = a.table(spark, sf_dir, "pages").select(
        F.substring_index("url", ":", 1).alias("poll_source"), k.alias("uid"), F.when(k % 3 == 0, "Paid").when(k % 3 == 1, "").alias("platform"), F.concat(F.lit("T"), k).alias("title"),
        F.col("html").alias("description"), F.when(k % 5 != 0, "10").alias("price"), F.col("url").alias("project_link"),
    )
    return parse.feed_to_jobs(projects).select("identity", "job_id", "source", "title", F.sha2("description", 256).alias("description_sha256"), "budget", "url", F.sha2("raw_text", 256).alias("raw_sha256"))


@query(sql.LEGACY)
def legacy_job_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by display source where it differs from the feed's identity."""
    shown = identity.source_display(F.col("source"), {"src1": "One"})
    return a.table(spark, sf_dir, "documents").select("doc_id", identity.legacy_job_uuid(shown, F.col("source"), F.col("doc_id")).alias("legacy_job_uuid"))


# --- matching and decisions


@query(sql.TIER_HITS)
def tier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lexicon = a.profiles(spark)
    found = match.keyword_counts(match.lexicon_occurrences(match.posts_text(a.jobs(spark, sf_dir, paragraphs=False), "doc_id"), lexicon, key="doc_id"), lexicon, "doc_id")
    named = match.tier_hits(found, "doc_id").join(bounded(lexicon, MAX_ROWS, "keywords"), [*match.TIER, "ord"])
    return named.select("doc_id", *match.TIER, "norm", "weight")


@query(sql.LONG_KEYWORDS)
def long_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of one to eight words, the beginnings of benchmark items, and the documents that hold them."""
    start = F.slice(F.split(text.normalize_text(F.col("text")), " "), 1, (F.col("item_id") % 8 + 1).cast("int"))
    rows = a.table(spark, sf_dir, "benchmark").select(
        F.lit("items").alias("profile_id"), F.lit("positive").alias("polarity"), F.lit("core").alias("tier"), F.lit("starts").alias("group"),
        F.array_join(start, " ").alias("keyword"), F.lit(1).alias("weight"), F.col("item_id").cast("int").alias("src_ord"),
    )
    lexicon = cut(compile_lexicon(rows), "long-keywords")
    found = match.lexicon_occurrences(match.posts_text(a.jobs(spark, sf_dir, paragraphs=False), "doc_id"), lexicon, key="doc_id").join(bounded(lexicon.select("ord", "norm"), MAX_ROWS, "keywords"), "ord")
    return found.groupBy("doc_id", "norm", F.col("n_tokens").cast("long").alias("n_tokens")).agg(F.bool_or("in_title").alias("in_title"))


@query(sql.CLASSIFIED)
def classify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("doc_id", "profile_id", "decision", "reason", "core_positive_count", "core_negative_count", "supporting_positive_weight", "supporting_negative_weight", "title_core_positive", "title_core_negative", "hard_reject", "matched")
    return _classified(spark, sf_dir).select(*keep)


@query(sql.DECISION_COUNTS)
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("profile_id", "decision", "reason").agg(F.count("*").alias("n"))


@query(sql.SELECTED)
def select_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(decide.select_category(_classified(spark, sf_dir), "doc_id").drop("all_ids"))


@query(sql.FINAL)
def final_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(_classified(spark, sf_dir), "classified")
    return _flat(decide.final_decision(found, decide.select_category(found, "doc_id"), "doc_id", a.jobs(spark, sf_dir)))


@query("""SELECT doc_id, 'Rejected' AS final_decision, 'No Enabled Categories' AS decision_reason, false AS needs_arbitration FROM documents""")
def no_enabled_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts when no profile is enabled."""
    profiles, lexicon = a.profiles(spark)
    jobs = a.jobs(spark, sf_dir, paragraphs=False)
    found = decide.classify_all(jobs, profiles.withColumn("enabled", F.lit(False)), lexicon, key="doc_id")
    return decide.final_decision(found, decide.select_category(found, "doc_id"), "doc_id", jobs).select("doc_id", "final_decision", "decision_reason", "needs_arbitration")


@query(sql.REVIEWED)
def apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third post gets its first candidate, the next none, the last no answer."""
    found = cut(_classified(spark, sf_dir), "classified")
    decided = decide.final_decision(found, decide.select_category(found, "doc_id"), "doc_id")
    said = F.when(F.col("doc_id") % 3 == 0, F.get("candidates", 0)).when(F.col("doc_id") % 3 == 1, "none")
    answers = decided.where("needs_arbitration").select("doc_id", said.alias("selected_category"), F.lit("said so").alias("reason"))
    return _flat(decide.apply_review(decided, answers, "doc_id"))


@query(sql.REPRESENTATIVE)
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(_classified(spark, sf_dir), "classified")
    return decide.representative(found, decide.select_category(found, "doc_id"), "doc_id").select("doc_id", "profile_id", "decision", "reason")


@query(sql.HARD)
def hard_reject_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lexicon = a.profiles(spark)
    found = match.keyword_counts(match.lexicon_occurrences(match.posts_text(a.jobs(spark, sf_dir, paragraphs=False), "doc_id"), lexicon, key="doc_id"), lexicon, "doc_id")
    return _flat(match.hard_reject_hits(found, "doc_id"))


@query(sql.REVIEW_PROMPT)
def review_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests about the profiles that want a review."""
    texts = a.table(spark, sf_dir, "documents").select("doc_id", text.truncate_text(F.col("text")).alias("text"))
    asked = _classified(spark, sf_dir).where("decision = 'review'").join(texts, "doc_id").withColumn("prompt", review.review_prompt(F.col("text")))
    return asked.select("doc_id", "profile_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query(sql.ARBITRATION_PROMPT)
def arbitration_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = a.table(spark, sf_dir, "documents").select("doc_id", text.truncate_text(F.col("text")).alias("text"))
    asked = review.arbitration_prompt(_classified(spark, sf_dir), texts, "doc_id")
    return asked.select("doc_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query(sql.FINAL_COUNTS)
def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a stream of files that comes twice, triaged batch by batch."""
    home = f"{shared_dir(spark)}/triage-{uuid4().hex}"
    kind = a.table(spark, sf_dir, "documents").schema
    arriving = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parquet*")
    arriving = arriving.union(spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parquet*"))
    as_posts = arriving.select(F.col("source").alias("identity"), F.col("doc_id").cast("string").alias("job_id"), "source", "text")
    stream.run_stream(as_posts, *a.profiles(spark), f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/out").groupBy("final_decision", "decision_reason").agg(F.count("*").alias("n"))


@query(sql.STREAM_CLAIMS)
def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts that land in four batches, three posts to a project, some far out of order; a claim lasts five days."""
    home = f"{shared_dir(spark)}/claims-{uuid4().hex}"
    k, files = F.col("doc_id"), 8
    hours = k - F.when(k % 7 == 0, 40 * 24).otherwise(0)
    linked = F.concat(F.coalesce("text", F.lit("")), F.lit("\nhttps://example.org/project/"), F.floor(k / 3))
    as_posts = a.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("identity"), k.cast("string").alias("job_id"), "source", linked.alias("text"), F.timestamp_seconds(F.lit(1704067200) + hours * 3600).alias("ts"))
    for part in range(4):
        as_posts.where(k % 4 == part).drop("doc_id").repartition(files).write.mode("append").parquet(f"{home}/landing")
    arriving = spark.readStream.schema(as_posts.drop("doc_id").schema).option("maxFilesPerTrigger", files).parquet(f"{home}/landing")
    stream.run_stream(arriving, *a.profiles(spark), f"{home}/out", f"{home}/checkpoint", ttl_seconds=5 * 24 * 3600).awaitTermination()
    return spark.read.parquet(f"{home}/out").select(F.col("job_id").cast("long").alias("doc_id"), "final_decision", "decision_reason")


# --- identity across feeds


@query(sql.CLAIMS)
def claim_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = a.events(spark, sf_dir).select(F.col("user_id").alias("project_id"), F.col("event_type").alias("job_uuid"), "ts", "event_id")
    return claims.claim_projects(asked, 5 * 24 * 3600, "event_id").select("event_id", "project_id", "owner", "claimed_at", "claimed")


@query("""SELECT doc_id FROM documents WHERE length(coalesce(text, '')) >= 1000 AND NOT (doc_id % 7 = 0 AND contains(source, 'src1'))""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post comes twice; the table has short ones, and every seventh of renamed sources under its older id."""
    shown = identity.source_display(F.col("identity"), {"src1": "One"})
    named = a.posts(spark, sf_dir).select("doc_id", "identity", F.length(F.coalesce("text", F.lit(""))).alias("n"), identity.job_uuid(F.col("identity"), F.col("job_id")).alias("job_uuid"), identity.legacy_job_uuid(shown, F.col("identity"), F.col("job_id")).alias("legacy_job_uuid"))
    held = named.where("n < 1000").select("job_uuid").unionByName(named.where("doc_id % 7 = 0 and legacy_job_uuid is not null").select(F.col("legacy_job_uuid").alias("job_uuid")))
    return audit.insert_if_absent(named.unionByName(named), held, legacy="legacy_job_uuid").select("doc_id")


@query("""WITH d AS (SELECT doc_id, doc_id // 3 AS p, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) = 1 AS owns FROM documents)
SELECT doc_id AS job_uuid, CASE WHEN doc_id % 5 = 0 OR owns THEN 'Accepted' ELSE 'Rejected' END AS final_decision, CASE WHEN doc_id % 5 = 0 OR owns THEN 'said so' ELSE 'Duplicate project from another source' END AS decision_reason,
  CASE WHEN doc_id % 5 = 0 OR owns THEN 'c' END AS category_id FROM d""")
def mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three posts of different feeds name each project, an hour apart; every fifth names none."""
    posts = a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_uuid"), F.floor(F.col("doc_id") / 3).alias("project_id"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("ts"))
    decided = posts.select("job_uuid", F.lit("Accepted").alias("final_decision"), F.lit("said so").alias("decision_reason"), F.lit("c").alias("category_id"))
    made = claims.claim_projects(posts).where("job_uuid % 5 <> 0")
    return claims.mark_duplicates(decided, made)


@query(sql.RESUME)
def resume_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post comes again; what the table holds of it depends on its number."""
    named = a.posts(spark, sf_dir).select("doc_id", F.col("doc_id").alias("job_uuid"), (F.col("doc_id") + 1_000_000).alias("legacy_job_uuid"))
    k = F.col("doc_id") % 6
    held = named.where(k < 5).select(
        F.when(k == 4, F.col("legacy_job_uuid")).otherwise(F.col("job_uuid")).alias("job_uuid"),
        F.when(k == 0, "Telegram: Failed").alias("notification_status"), F.when(k == 1, "Accepted").when(k == 2, "Rejected").alias("final_decision"),
    )
    return review.resume_action(named, held).select("doc_id", "action")


@query("""SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN nullif(url, '') END AS url FROM pages""")
def button_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages in the second row of their posts' buttons, behind rows and buttons without one; every third has none."""
    button = lambda c: F.struct(c.cast("string").alias("url"))
    none, rows = button(F.lit(None)), F.lit(None).cast("array<struct<url:string>>")
    linked = F.array(rows, F.array(none, button(F.lit(""))), F.array(none, button(F.col("url"))))
    buttons = F.when(F.col("page_id") % 3 == 0, F.array(F.array(none))).otherwise(linked)
    return a.table(spark, sf_dir, "pages").select("page_id", parse.button_url(buttons).alias("url"))


@query("""SELECT o_orderkey AS job_uuid, '' AS title, o_comment AS description, o_clerk AS source, CASE WHEN o_orderstatus = 'P' THEN 'Accepted' ELSE o_orderstatus END AS decision, '' AS decision_reason,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS url, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus || ', ' || o_orderpriority END AS categories, '' AS category_id, o_orderkey % 4 < 2 AS ai_used
FROM (SELECT *, 'of ' || o_orderkey AS o_comment, 'Clerk ' || o_custkey AS o_clerk FROM orders)""")
def resume_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as stored posts that lack this and that."""
    k = F.col("o_orderkey")
    stored = a.table(spark, sf_dir, "orders").select(
        k.alias("job_uuid"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("of "), k).alias("description"), F.concat(F.lit("Clerk "), F.col("o_custkey")).alias("source"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("final_decision"), F.lit("").alias("decision_reason"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("url"),
        F.when(k % 3 != 0, F.concat(F.lit(" , "), F.col("o_orderstatus"), F.lit(" ,"), F.col("o_orderpriority"), F.lit(" ,,"))).alias("categories"), F.lit("").alias("category_id"),
        F.when(k % 4 == 0, " Yes ").when(k % 4 == 1, "1").when(k % 4 == 2, "no").alias("needs_review"),
    )
    return _flat(review.resume_payload(stored))


@query("""SELECT DISTINCT lang AS profile_id, source AS keyword FROM documents WHERE doc_id % 2 = 0 AND doc_id % 4 <> 0 AND (lang, source) IN (SELECT (lang, source) FROM documents WHERE doc_id % 3 = 0)""")
def lexicon_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as keywords of the profiles of their documents' languages, and as noise words."""
    k, docs = F.col("doc_id"), a.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("profile_id"), F.col("source").alias("keyword"))
    scored = docs.where(k % 2 == 0).withColumn("polarity", F.when(k % 4 == 0, "hard_reject").otherwise("positive"))
    return lexicon_conflicts_of(scored, docs.where(k % 3 == 0))


@query(sql.POLICIES)
def arbitration_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions on the candidates of each post; one profile has no policy text."""
    profiles, _ = a.profiles(spark)
    policies = profiles.select(F.col("id").alias("profile_id"), F.when(F.col("id") != "romance", F.concat(F.lit("  Wants "), F.col("id"), F.lit("\n"))).alias("policy"))
    return review.arbitration_policy(_classified(spark, sf_dir).where("decision <> 'reject'"), policies, key="doc_id")


@query(sql.EVIDENCE)
def audit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each post and profile as text, as the audit tables hold them."""
    lists = [f"{p}_{t}" for p, t in decide.LISTS]
    return _classified(spark, sf_dir).select("doc_id", "profile_id", *(match.format_matches(F.col(f"{n}_matches")).alias(n) for n in lists))


# --- feeds


@query(sql.BACKLOG)
def channel_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = a.messages(spark, sf_dir).where("chat_id % 3 <> 0").groupBy("chat_id").agg(F.min("msg_id").alias("last_id"))
    return feeds.channel_backlog(a.messages(spark, sf_dir), seen, 20).select("chat_id", "msg_id", F.col("backlog_rank").cast("long").alias("backlog_rank"))


@query(sql.BACKLOG.replace("k <= 20", "k <= 2000"))
def channel_backlog_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel_backlog with the operator's own limit."""
    seen = a.messages(spark, sf_dir).where("chat_id % 3 <> 0").groupBy("chat_id").agg(F.min("msg_id").alias("last_id"))
    return feeds.channel_backlog(a.messages(spark, sf_dir), seen).select("chat_id", "msg_id", F.col("backlog_rank").cast("long").alias("backlog_rank"))


@query("""SELECT chat_id, last_id FROM (SELECT user_id AS chat_id, CASE WHEN user_id % 3 = 0 THEN max(event_id) ELSE min(event_id) END AS last_id FROM events GROUP BY user_id)""")
def seed_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = a.messages(spark, sf_dir).where("chat_id % 3 <> 0").groupBy("chat_id").agg(F.min("msg_id").alias("last_id"))
    return feeds.seed_watermarks(a.messages(spark, sf_dir), seen)


@query("""WITH w AS (SELECT user_id AS chat_id, min(event_id) AS last_id FROM events WHERE user_id % 3 <> 0 GROUP BY 1),
m AS (SELECT e.user_id AS chat_id, e.event_id, e.event_type FROM events e LEFT JOIN w ON w.chat_id = e.user_id WHERE e.event_id > coalesce(w.last_id, 0)),
f AS (SELECT chat_id, min(event_id) AS bad FROM m WHERE event_type = 'error' GROUP BY 1),
n AS (SELECT m.chat_id, max(m.event_id) AS new_id FROM m LEFT JOIN f USING (chat_id) WHERE event_type <> 'error' AND (bad IS NULL OR event_id < bad) GROUP BY 1)
SELECT e.chat_id, greatest(coalesce(n.new_id, 0), coalesce(w.last_id, 0)) AS last_id FROM (SELECT DISTINCT user_id AS chat_id FROM events) e LEFT JOIN w USING (chat_id) LEFT JOIN n USING (chat_id)""")
def advance_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = a.messages(spark, sf_dir).where("chat_id % 3 <> 0").groupBy("chat_id").agg(F.min("msg_id").alias("last_id"))
    return feeds.advance_watermark(a.messages(spark, sf_dir), seen)


@query("""WITH m AS (SELECT user_id AS chat_id, event_id AS id, event_type = 'error' AND event_id % 2 = 1 AS open FROM events),
f AS (SELECT chat_id, min(id) AS bad FROM m WHERE open GROUP BY 1)
SELECT chat_id, max(id) AS last_id FROM m LEFT JOIN f USING (chat_id) WHERE NOT open AND (bad IS NULL OR id < bad) GROUP BY 1""")
def watermark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages of a stream: they land in two halves, then every second failure comes again and succeeds."""
    home = f"{shared_dir(spark)}/channels-{uuid4().hex}"
    results = a.messages(spark, sf_dir).select("chat_id", "msg_id", "ok")
    middle = results.agg(F.coalesce(F.max("msg_id"), F.lit(0))).first()[0] // 2
    again = results.where(~F.col("ok") & (F.col("msg_id") % 2 == 0)).withColumn("ok", F.lit(True))
    for part in (results.where(F.col("msg_id") <= middle), results.where(F.col("msg_id") > middle), again):
        part.repartition(8).write.mode("append").parquet(f"{home}/landing")
    arriving = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 8).parquet(f"{home}/landing")
    steps = channels.watermark_stream(arriving)
    _run_stateful(steps, home)
    return spark.read.schema("chat_id long, last_id long, n_failed int").parquet(f"{home}/out").groupBy("chat_id").agg(F.max("last_id").alias("last_id"))


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.events(spark, sf_dir).select(F.concat("event_type", F.lit("-"), F.col("user_id") % 20).alias("poll_source"), F.col("event_id").cast("string").alias("uid"), (-F.col("event_id")).alias("posted_rank"))


@query(sql.PAGED)
def paged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.paged_feed(_projects(spark, sf_dir), 7).select("poll_source", "uid", "page")


@query(sql.CATCHUP)
def feed_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _projects(spark, sf_dir)
    seen = every.where("uid % 37 = 0 and poll_source not like 'view%'")
    return feeds.feed_catchup(feeds.paged_feed(every, 7), seen).select("poll_source", "uid", "page", F.col("arrival").cast("long").alias("arrival"))


def _full_pages(twin: str) -> str:
    return twin.replace("(k - 1) // 7", "(k - 1) // 30").replace("k <= 70", "k <= 300")


@query(_full_pages(sql.PAGED))
def paged_feed_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paged_feed with the operator's own page size."""
    return feeds.paged_feed(_projects(spark, sf_dir)).select("poll_source", "uid", "page")


@query(_full_pages(sql.CATCHUP))
def feed_catchup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed_catchup with the operator's own page size."""
    every = _projects(spark, sf_dir)
    seen = every.where("uid % 37 = 0 and poll_source not like 'view%'")
    return feeds.feed_catchup(feeds.paged_feed(every), seen).select("poll_source", "uid", "page", F.col("arrival").cast("long").alias("arrival"))


@query(sql.CAUGHT_UP)
def catchup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of events as a stream of polls: a first one seeds, the second finds projects, every third of which is processed, the third reads the same pages again."""
    home = f"{shared_dir(spark)}/catchup-{uuid4().hex}"
    page = cut(feeds.paged_feed(_projects(spark, sf_dir), 7), "pages")
    listed = lambda rows: rows.groupBy("poll_source", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("feed_rank", "uid"))), lambda x: x["uid"]).alias("uids"))
    polled = lambda rows, seq: listed(rows).groupBy("poll_source").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "uids"))), lambda x: x["uids"]).alias("pages")).select("poll_source", F.lit(seq).cast("long").alias("seq"), "pages", F.lit(None).cast("string").alias("uid"), F.lit(None).cast("boolean").alias("ok"))
    seeds = page.where("uid % 5 = 0 and poll_source not like 'view%'").withColumn("page", F.lit(1))
    stop = page.where("uid % 5 = 0").groupBy("poll_source").agg(F.min("page").alias("stop"))
    # what is found of sources that were seeded, up to the first page with a seed
    ended = page.join(stop, "poll_source").where("uid % 5 <> 0 and page <= stop and poll_source not like 'view%'").select("poll_source", (F.lit(2) + F.col("feed_rank")).cast("long").alias("seq"), F.lit(None).cast("array<array<string>>").alias("pages"), "uid", (F.col("uid") % 3 == 0).alias("ok"))
    seeded = page.join(seeds.select("poll_source").distinct(), "poll_source", "left_semi")
    for part in (polled(seeds, 1), polled(seeded, 2), ended, polled(seeded, 1000)):
        part.repartition(8).write.mode("append").parquet(f"{home}/landing")
    arriving = spark.readStream.schema(catchup.EVENTS).option("maxFilesPerTrigger", 8).parquet(f"{home}/landing")
    _run_stateful(catchup.catchup_stream(arriving, 7), home)
    return spark.read.schema(catchup.FOUND).parquet(f"{home}/out")


@query("""SELECT user_id AS chat_id, event_id AS msg_id, 'm' || event_id AS text FROM events WHERE user_id IN (1, 3, 5, 8)""")
def read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of some channels, from a landing folder of JSON files that events are written to."""
    home = f"{shared_dir(spark)}/landing-{uuid4().hex}"
    a.messages(spark, sf_dir).select("chat_id", "msg_id", "ts", F.concat(F.lit("m"), "msg_id").alias("text")).write.json(home)
    return feeds.read_messages(spark, home, [1, 3, 5, 8]).select("chat_id", "msg_id", "text")


@query("""SELECT event_type AS poll_source, event_id::VARCHAR AS uid, value::VARCHAR AS price FROM (SELECT event_type, event_id, user_id AS value FROM events)""")
def read_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = f"{shared_dir(spark)}/landing-{uuid4().hex}"
    a.events(spark, sf_dir).select(F.col("event_type").alias("poll_source"), F.col("event_id").cast("string").alias("uid"), F.col("user_id").cast("string").alias("price")).write.json(home)
    return feeds.read_projects(spark, home).select("poll_source", "uid", "price")


@query("""SELECT poll_source, seen_seq::VARCHAR AS uid, seen_seq FROM (SELECT event_type AS poll_source, event_id AS seen_seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events WHERE event_id % 2 = 0 OR value > 5) WHERE k <= 500""")
def trim_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.events(spark, sf_dir).select(F.col("event_type").alias("poll_source"), F.col("event_id").cast("string").alias("uid"), F.col("event_id").alias("seen_seq"), (F.col("value") > 5).alias("ok"))
    seen = feeds.mark_seen(rows.where("seen_seq % 2 = 0"), rows)
    return feeds.trim_seen(seen).select("poll_source", "uid", "seen_seq")


# --- routing and the queue


@query("""SELECT user_id, event_type AS category_id FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def subscription_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.subscription_state(a.events(spark, sf_dir).select("user_id", F.col("event_type").alias("category_id"), F.col("event_id").alias("seq")))


@query("""SELECT c_custkey AS user_id, (c_custkey // 3)::VARCHAR AS category_id FROM customer WHERE c_acctbal >= 0""")
def category_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.category_subscribers(a.users(spark, sf_dir), a.subscriptions(spark, sf_dir)).select("user_id", "category_id")


@query("""SELECT o_orderkey AS job_uuid, c_custkey AS user_id FROM orders JOIN customer ON c_custkey // 3 = o_custkey // 3 WHERE o_orderstatus <> 'P' AND c_acctbal >= 0 AND NOT (o_totalprice > 300000 AND c_custkey = o_custkey)""")
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of expensive orders are queued already."""
    queued = a.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("job_uuid"), F.col("o_custkey").alias("user_id"))
    return route.fanout(a.sold(spark, sf_dir), a.users(spark, sf_dir), a.subscriptions(spark, sf_dir), queued).select("job_uuid", "user_id")


@query("""WITH latest AS (SELECT doc_id, toxic, quality FROM labels) SELECT o_orderkey AS job_uuid, c_custkey AS user_id FROM orders JOIN customer ON c_custkey // 3 = o_custkey // 3
WHERE o_orderstatus <> 'P' AND c_acctbal >= 0 AND o_custkey % 4 <> 1 AND o_custkey % 4 <> 3""")
def fanout_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post of four is denied, one not evaluated yet, one was reviewed."""
    k = F.col("o_custkey") % 4
    log = a.table(spark, sf_dir, "orders").where(k != 3).select(F.col("o_orderkey").alias("job_uuid"), F.when(k == 0, "notify").when(k == 1, "do_not_notify").otherwise("error").alias("guard_decision"), F.lit(1).alias("seq"))
    reviewed = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_uuid"), (k == 2).alias("reviewed"))
    return route.fanout(a.sold(spark, sf_dir).join(reviewed, "job_uuid"), a.users(spark, sf_dir), a.subscriptions(spark, sf_dir), guard=log).select("job_uuid", "user_id")


@query("""SELECT o_orderkey AS job_uuid, count(*) AS n_queued FROM orders JOIN customer ON c_custkey // 3 = o_custkey // 3 WHERE o_orderstatus <> 'P' AND c_acctbal >= 0 GROUP BY 1""")
def fanout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.fanout_counts(route.fanout(a.sold(spark, sf_dir), a.users(spark, sf_dir), a.subscriptions(spark, sf_dir)))


@query(sql.CLAIM_BATCH)
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.claim_batch(a.queue(spark, sf_dir), a.users(spark, sf_dir), F.expr(a.ORDERS_NOW)).select("notification_id", "user_id", "status", "attempts")


@query(sql.OUTCOMES)
def apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = a.queue(spark, sf_dir)
    k = F.col("seq") % 5
    said = F.when(k == 0, "ok").when(k == 1, "rate_limited").when(k == 2, "forbidden").when(k == 3, "error")
    outcomes = queue.where("status = 'Sending'").select("notification_id", said.alias("outcome"), F.lit(30).alias("retry_after_s"), F.lit("refused").alias("error"))
    return route.apply_outcomes(queue, outcomes, F.expr(a.ORDERS_NOW)).select("notification_id", "status", "attempts", "last_error", "next_attempt_at", "deactivate")


@query(sql.SWEPT)
def retry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as accepted posts whose sends fail up to three times; the guard holds back every fifth."""
    home = f"{shared_dir(spark)}/sweep-{uuid4().hex}"
    k, start = F.col("doc_id"), F.lit(1704067200) + 7 * F.col("doc_id")
    docs = a.table(spark, sf_dir, "documents").select("doc_id")
    row = lambda kind, s, ok, guard: docs.select(k.cast("string").alias("job_uuid"), F.lit(kind).alias("kind"), F.timestamp_seconds(start + s).alias("ts"), ok.alias("ok"), guard.alias("guard"), k)
    no, silent = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    events = row("accepted", 0, no, silent).unionByName(row("guard", 50, no, F.lit("do_not_notify")).where(k % 5 == 0))
    for n in range(4):
        events = events.unionByName(row("sent", 400 * (n + 1), k % 4 == n, silent).where(k % 4 >= n))
    events.drop("doc_id").repartition(8).write.parquet(f"{home}/landing")
    arriving = spark.readStream.schema(events.drop("doc_id").schema).parquet(f"{home}/landing")
    changes = sweep.sweep_stream(arriving)
    _run_stateful(changes, home)
    return sweep.notifications_after(spark.read.schema(sweep.CHANGES).parquet(f"{home}/out")).select(F.col("job_uuid").cast("long").alias("doc_id"), "status", "sends")


@query(sql.DELIVERED)
def delivery_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as notifications that land in two batches with the ends of their sends, up to six of which fail."""
    home = f"{shared_dir(spark)}/delivery-{uuid4().hex}"
    k, start, sends = F.col("o_orderkey"), F.lit(1704067200) + F.col("o_orderkey"), (0, 11, 32, 73, 154)
    orders = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, s, outcome, error: orders.select("user_id", F.lit(kind).alias("kind"), k.alias("notification_id"), F.timestamp_seconds(start + s).alias("ts"), outcome.alias("outcome"), none("long").alias("retry_after_s"), error.alias("error"), none("boolean").alias("active"))
    events = row("queued", 0, none("string"), none("string"))
    for n, s in enumerate(sends):
        sent = k % 7 == n
        ends = row("outcome", s + 1, F.when(sent, "ok").otherwise("error"), F.when(~sent, "no"))
        events = events.unionByName(ends.where(F.col("notification_id") % 7 >= n))
    middle = orders.agg(F.coalesce(F.max("o_orderkey"), F.lit(0))).first()[0] // 2
    early = F.unix_seconds("ts") < 1704067200 + middle
    for part in (early, ~early):
        events.where(part).repartition(8).write.mode("append").parquet(f"{home}/landing")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{home}/landing")
    changes = delivery.delivery_stream(arriving)
    _run_stateful(changes, home)
    return delivery.queue_after(spark.read.schema(delivery.CHANGES).parquet(f"{home}/out"))


@query(sql.RESET)
def reset_sending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.reset_sending(a.queue(spark, sf_dir), F.expr(a.ORDERS_NOW)).select("notification_id", "status", "attempts", "next_attempt_at")


@query("""SELECT c_custkey AS user_id, c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 7) AS is_active FROM customer""")
def deactivate_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = a.queue(spark, sf_dir).withColumn("deactivate", F.col("seq") % 50 == 7)
    return route.deactivate_users(a.users(spark, sf_dir), queue).select("user_id", "is_active")


@query("""SELECT o_orderkey AS notification_id, c_name AS destination, 'post ' || o_orderkey AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'http://x/' || o_orderkey END AS button_url FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 10 <> 3""")
def build_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of queue rows whose post is there; every second has a link."""
    k = F.col("o_orderkey")
    jobs = a.table(spark, sf_dir, "orders").where(k % 10 != 3).select(k.alias("job_uuid"), F.when(k % 2 == 0, F.concat(F.lit("http://x/"), k)).otherwise("").alias("url"))
    rows = route.delivery_rows(a.queue(spark, sf_dir), jobs).join(a.users(spark, sf_dir).select("user_id", "external_id"), "user_id")
    return route.build_outbox(rows, F.concat(F.lit("post "), F.col("job_uuid")))


@query("""SELECT o_orderkey AS notification_id FROM orders WHERE o_orderkey % 6 = 5 AND NOT (o_orderstatus = 'P' AND o_orderkey % 3 <> 0)""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.dead_letters(a.queue(spark, sf_dir)).select("notification_id")


@query("""SELECT o_orderkey AS notification_id, CASE WHEN c.job IS NULL THEN 'Job record not found' END AS problem FROM orders LEFT JOIN (SELECT o_orderkey AS job FROM orders WHERE o_totalprice > 1000 AND o_orderkey % 10 <> 3) c ON c.job = o_orderkey""")
def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = a.table(spark, sf_dir, "orders").where("o_totalprice > 1000 and o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("job_uuid"), F.lit("").alias("url"))
    return route.delivery_rows(a.queue(spark, sf_dir), jobs).select("notification_id", "problem")


@query("""SELECT user_id, string_agg(name, ', ' ORDER BY seq) AS names FROM (SELECT user_id, upper(event_type) AS name, min(event_id) AS seq FROM events WHERE event_type <> 'error' GROUP BY 1, 2) GROUP BY 1""")
def subscription_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.events(spark, sf_dir)
    categories = e.select(F.col("event_type").alias("category_id")).distinct().select("category_id", F.upper("category_id").alias("name"), (F.col("category_id") != "error").alias("enabled"))
    return _flat(route.subscription_summary(e.select("user_id", F.col("event_type").alias("category_id"), F.col("event_id").alias("seq")), categories))


# --- review and guard


@query(sql.GUARD_PROMPT)
def guard_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = review.guard_prompt(F.col("title"), F.col("description"))
    return a.jobs(spark, sf_dir).select("doc_id", F.length(asked).cast("long").alias("n_chars"), F.sha2(asked, 256).alias("prompt_sha256"))


@query("""SELECT event_id AS job_uuid, 'review' AS decision_before, event_type AS reason_before, user_id AS response_time_ms, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'c' END AS decision, round(value, 6) AS confidence FROM events WHERE event_id % 4 <> 0""")
def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events; every fourth failed."""
    e = a.events(spark, sf_dir)
    k = F.col("event_id")
    said = e.select(k.alias("job_uuid"), F.when(k % 4 == 0, None).when(k % 3 == 0, "none").otherwise("c").alias("selected_category"), F.round("value", 6).alias("confidence"), F.col("user_id").alias("response_time_ms"))
    before = e.select(k.alias("job_uuid"), F.lit("review").alias("decision"), F.col("event_type").alias("reason"))
    return review.review_log(said, before)


@query("""SELECT event_id, lower(coalesce(event_type, '')) IN ('error') OR event_id % 3 = 0 AS again FROM events""")
def transient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors made of events: some say that the service is unavailable or that the quota is exceeded."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("HTTP 429 at "), F.col("event_type"))).when(F.col("event_type") == "error", "Service UNAVAILABLE").otherwise(F.concat(F.lit("odd "), F.col("event_type")))
    return a.events(spark, sf_dir).select("event_id", review.transient_errors(said).alias("again"))


@query(sql.LATEST_GUARD)
def guard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_uuid"), (F.col("doc_id") % 11 == 0).alias("reviewed"))
    return review.guard_gate(posts, a.guard_log(spark, sf_dir)).select("job_uuid", "guard_decision", "gate")


@query(sql.ADVANCE)
def advance_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(x) for x in ("", "Pending", "Telegram: Failed", "Complete", "Telegram: Sent"))), (F.col("doc_id") % 5 + 1).cast("int"))
    posts = a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_uuid"), status.alias("notification_status"))
    attempts = posts.where("job_uuid % 7 <> 0").select("job_uuid", (F.col("job_uuid") % 2 == 0).alias("sent"))
    return review.advance_private(posts, attempts, a.guard_log(spark, sf_dir))


@query(sql.GUARD_RESULTS)
def guard_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of labels, some odd, some of a profile that isn't there."""
    said = F.when(F.col("toxic") == 1, '{"decision": "do_not_notify"}').when(F.col("quality") == 1, '{"decision": "notify"}').otherwise('{"decision": 1}')
    tries = a.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_uuid"), F.when(F.col("doc_id") % 5 == 0, "gone").otherwise("english").alias("profile_id"), said.alias("raw"), F.lit(None).cast("string").alias("error"))
    return review.guard_results(tries, a.profiles(spark)[0]).select("job_uuid", "guard_decision")


@query(sql.REVIEWS)
def validate_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events, some of them spoilt."""
    k = F.col("event_id") % 6
    skills = F.when(k == 1, "[1]").when(k == 2, '"a"').otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('"]')))
    raw = F.concat(F.lit('{"decision": "'), F.when(k == 3, "maybe").when(F.col("value") > 10, "accept").otherwise("reject"), F.lit('", "confidence": '), F.col("value").cast("string"), F.lit(', "project_type": "p", "primary_deliverable": "d", "reason": "", "skills_detected": '), skills, F.lit("}"))
    answer = review.validate_review(raw)
    return a.events(spark, sf_dir).select("event_id", answer["decision"].alias("decision"), F.round(answer["confidence"], 6).alias("confidence"), F.array_join(answer["skills"], ", ").alias("skills"))


@query(sql.INCOMPLETE)
def incomplete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("string")).when(F.col("o_orderpriority").startswith("5"), "").when(F.col("o_orderpriority").startswith("1"), "Complete").otherwise("Pending")
    return review.incomplete_jobs(a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_uuid"), status.alias("notification_status"))).select("job_uuid")


@query(sql.ARBITRATIONS)
def validate_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events, some of them spoilt."""
    k = F.col("event_id") % 8
    confidence = F.when(k == 1, '"90"').when(k == 2, "true").when(k == 3, "101").when(k == 4, "null").otherwise(F.col("value").cast("string"))
    raw = F.concat(F.lit('{"selected_category": "'), F.when(k == 5, "none").otherwise(F.col("event_type")), F.lit('", "confidence": '), confidence, F.lit(', "reason": "'), F.col("event_type"), F.when(k == 6, "").otherwise(F.lit('"}')))
    answer = review.validate_arbitration(F.when(k == 7, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(raw), F.array(*map(F.lit, ("view", "click", "signup"))))
    return a.events(spark, sf_dir).select("event_id", answer["selected_category"].alias("selected_category"), F.round(answer["confidence"], 6).alias("confidence"))


@query(sql.FIRST_VALID)
def first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = a.events(spark, sf_dir).select(F.col("user_id").alias("job_uuid"), F.col("event_id").alias("provider_rank"), F.lit(0).alias("key_rank"), "event_type", F.col("event_type").alias("error"))
    return review.first_valid_attempt(tries, F.when(F.col("event_type") == "signup", F.col("event_type"))).select("job_uuid", "answer", "errors")


# --- messages and audit


@query(sql.SUBSCRIBER)
def render_subscriber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.jobs(spark, sf_dir).join(a.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "title", "description", "source", F.array("lang", F.lit("two words")).alias("categories"), F.lit(" Text & more ").alias("category_name"))
    return rows.select("doc_id", F.sha2(render.render_subscriber({"src1": "One"}), 256).alias("message_sha256"))


@query(sql.PRIVATE)
def render_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.jobs(spark, sf_dir).join(a.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    rows = rows.select("doc_id", "title", "description", "source", F.array("lang").alias("categories"), F.lit("").alias("budget"), F.col("text").alias("reason"), (F.col("doc_id") % 2 == 0).alias("ai_used"))
    message = render.render_private()
    return rows.select("doc_id", F.length(message).cast("long").alias("n_chars"), F.sha2(message, 256).alias("message_sha256"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer""")
def apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = a.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    news = held.where("c_custkey % 4 = 0").select("c_custkey", F.array(F.lit("moved")).alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(1).alias("unknown"))
    return audit.apply_updates(held, news.unionByName(news.limit(0)), "c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'again' WHEN o_orderkey % 3 = 0 THEN 'moved' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 0 ELSE o_totalprice END AS o_totalprice, (o_orderkey % 7 = 0)::BIGINT AS made
FROM orders""")
def keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of orders that takes batches: updates of all, of which some aren't there yet, then those as inserts, one batch twice, folded in between."""
    o = a.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    held = KeyedTable(f"{shared_dir(spark)}/orders-{uuid4().hex}", "o_orderkey", o.withColumn("made", F.lit(0).cast("long")).schema, once=("made",))
    late = F.col("o_orderkey") % 7 == 0
    held.create(o.where(~late).withColumn("made", F.lit(0)))
    held.put(o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("moved").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")), 1, inserts=False)
    held.compact(spark, 1)
    inserted = o.where(late).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "moved").otherwise(F.col("o_orderstatus"))).withColumn("made", F.lit(1))
    held.put(inserted, 2)
    held.put(o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("again").alias("o_orderstatus"), F.lit(9).alias("made")), 3)
    held.put(inserted, 2)
    return held.read(spark)


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_acctbal < 0""")
def absent_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table lacks customers in the red."""
    c = a.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return audit.absent_updates(c.where("c_acctbal >= 0"), c.where("c_custkey % 4 = 0"), "c_custkey").select("c_custkey")


@query("""SELECT event_id, event_type, true AS logged FROM events UNION ALL SELECT event_id, 'again', true FROM events WHERE event_id % 3 = 0""")
def append_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written twice."""
    path = f"{shared_dir(spark)}/audit-{uuid4().hex}"
    rows = a.events(spark, sf_dir).select("event_id", "event_type")
    audit.append_audit(rows, path)
    audit.append_audit(rows.where("event_id % 3 = 0").withColumn("event_type", F.lit("again")), path)
    return spark.read.parquet(path).select("event_id", "event_type", F.col("logged_at").isNotNull().alias("logged"))


@query("""SELECT n_name AS category_id, n_name AS name, n_nationkey % 2 = 0 OR n_nationkey % 3 <> 0 AS enabled FROM nation""")
def seed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third nation is in the catalogue, the odd ones of them disabled; all are profiles."""
    n, now = a.table(spark, sf_dir, "nation"), F.expr(a.NOW)
    held = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("category_id"), F.col("n_name").alias("name"), F.lit("").alias("description"), (F.col("n_nationkey") % 2 == 0).alias("enabled"), now.alias("created_at"))
    return audit.seed_categories(held, n.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("description")), now).select("category_id", "name", "enabled")


@query("""SELECT CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 2 = 1 THEN c_custkey::VARCHAR END AS user_id, c_name AS external_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS username,
  CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END AS first_name, 'user' AS destination_type, c_custkey % 2 = 0 OR c_acctbal >= 0 AS is_active, TIMESTAMP '2024-01-01' + to_hours(CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 2 = 1 THEN 0 ELSE 744 END) AS created_at,
  TIMESTAMP '2024-01-01' + to_hours(CASE WHEN c_custkey % 2 = 0 THEN 744 ELSE 0 END) AS updated_at FROM customer""")
def upsert_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new destinations are random, so they come as null."""
    c, now, before = a.table(spark, sf_dir, "customer"), F.expr(a.NOW), F.expr("timestamp'2024-01-01 00:00:00'")
    held = c.where("c_custkey % 3 <> 0 or c_custkey % 2 = 1").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("external_id"), F.lit("old").alias("username"), F.lit("").alias("first_name"), F.lit("user").alias("destination_type"), (F.col("c_acctbal") >= 0).alias("is_active"), before.alias("created_at"), before.alias("updated_at"))
    came = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("external_id"), F.lit("new").alias("username"), F.lit("x").alias("first_name"), F.lit("user").alias("destination_type"))
    done = audit.upsert_destinations(held, came, now)
    return done.withColumn("user_id", F.when(F.length("user_id") < 36, F.col("user_id")))


@query("""SELECT o_orderkey AS job_uuid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS final_decision, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE NULL END AS filter_time_ms FROM orders""")
def merge_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    o = a.table(spark, sf_dir, "orders")
    layout = StructType().add("job_uuid", LongType()).add("final_decision", StringType()).add("filter_time_ms", DoubleType())
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("Job UUID"), F.col("o_orderstatus").alias("Final Decision"), F.col("o_totalprice").cast("string").alias("Filter Time (ms)"))
    current = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("job_uuid"), F.lit(None).cast("string").alias("final_decision"), F.lit(None).cast("double").alias("filter_time_ms"))
    aligned = audit.align_schema(old.unionByName(old), layout, key=["job_uuid"])
    return audit.merge_legacy(audit.merge_legacy(current, aligned, ["job_uuid"]), aligned, ["job_uuid"])


@query("""SELECT 'jobs' AS name, count(*) AS n FROM documents UNION ALL SELECT 'queue', count(*) FROM orders UNION ALL SELECT 'guard', count(*) FROM labels""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_counts(**{k: a.table(spark, sf_dir, t) for k, t in (("jobs", "documents"), ("queue", "orders"), ("guard", "labels"))})


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def lookup_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = a.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return audit.lookup_jobs(a.table(spark, sf_dir, "orders"), wanted, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("""SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1""")
def last_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.last_job(a.events(spark, sf_dir).select("event_id", "event_type"), "event_id")
