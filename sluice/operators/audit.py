"""Audit tables: inserts, updates and upserts as joins; old layouts; counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str = "job_uuid", legacy: str | None = None) -> DataFrame:
    """Rows of `new`, one for each key, that `existing` has under neither their key nor their legacy key."""
    held = existing.select(F.col(key).alias("held")).distinct()
    fresh = new.dropDuplicates([key]).join(held, F.col(key) == F.col("held"), "left_anti")
    return fresh if legacy is None else fresh.join(held, F.col(legacy) == F.col("held"), "left_anti")


def append_audit(rows: DataFrame, path: str) -> None:
    """Append rows with the time of writing."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def apply_updates(table: DataFrame, updates: DataFrame, key: str = "job_uuid") -> DataFrame:
    """`table` with the values that `updates` (one row a key) has; null leaves a value, unknown columns and keys do nothing, lists are joined by commas."""
    known = [c for c in updates.columns if c != key and c in table.columns]
    lists = {f.name for f in updates.schema.fields if f.dataType.typeName() == "array"}
    value = lambda c: F.array_join(c, ", ") if c in lists and table.schema[c].dataType.typeName() == "string" else F.col(c)
    new = updates.select(key, *(value(c).alias(f"new_{c}") for c in known))
    return table.join(new, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in known else c for c in table.columns))


def absent_updates(table: DataFrame, updates: DataFrame, key: str = "job_uuid") -> DataFrame:
    """Updates that change nothing, since `table` doesn't have their key."""
    return updates.join(table.select(key).distinct(), key, "left_anti")


def lookup_jobs(jobs: DataFrame, keys: DataFrame, key: str = "job_uuid") -> DataFrame:
    return jobs.join(keys.select(key).distinct(), key, "left_semi")


def upsert_destinations(users: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Destinations after those in `incoming` (external_id, username, first_name, destination_type) showed up: names renewed, activated, new ones with an id."""
    latest = incoming.dropDuplicates(["external_id"]).select("external_id", *(F.col(c).alias(f"new_{c}") for c in ("username", "first_name", "destination_type")), F.lit(True).alias("came"))
    both = users.join(latest, "external_id", "full_outer")
    new = lambda c: F.when(F.col("came"), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c)
    return both.select(
        F.coalesce("user_id", F.uuid()).alias("user_id"), "external_id", new("username"), new("first_name"), new("destination_type"),
        (F.coalesce("came", F.lit(False)) | F.coalesce("is_active", F.lit(False))).alias("is_active"),
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("came"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def seed_categories(categories: DataFrame, profiles: DataFrame, now) -> DataFrame:
    """Categories with those of the profiles that were missing."""
    new = profiles.select(F.col("id").alias("category_id"), "name", "description", F.lit(True).alias("enabled"), now.alias("created_at"))
    return categories.unionByName(new.join(categories, "category_id", "left_anti"))


def subscription_state(toggles: DataFrame) -> DataFrame:
    """Subscriptions (user_id, category_id) after a log of toggles with `seq`: an odd number of toggles subscribes; `enabled` in the log, if any, counts as it was last."""
    if "enabled" in toggles.columns:
        state = toggles.groupBy("user_id", "category_id").agg(F.max_by("enabled", "seq").alias("on"))
    else:
        state = toggles.groupBy("user_id", "category_id").agg((F.count("*") % 2 == 1).alias("on"))
    return state.where("on").drop("on")


def align_schema(legacy: DataFrame, schema: StructType, renames: Mapping[str, str] | None = None, key: Sequence[str] = ()) -> DataFrame:
    """An old table in a new layout: headers spelt with underscores, known columns cast, missing ones null, one row for each key.

    Fails if no column is recognised.
    """
    spelt = lambda c: (renames or {}).get(c, c.strip().lower().replace("(", "").replace(")", "").replace(" ", "_"))
    of = {spelt(c): c for c in legacy.columns}
    if not of.keys() & set(schema.names):
        raise ValueError(f"no column of {legacy.columns} belongs to {schema.names}")
    out = legacy.select(*((F.col(f"`{of[f.name]}`") if f.name in of else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields))
    return out.dropDuplicates(list(key)) if key else out


def merge_legacy(current: DataFrame, legacy: DataFrame, key: Sequence[str]) -> DataFrame:
    """`current` with rows of an aligned old table whose key it lacks; running it twice changes nothing."""
    fresh = legacy.dropDuplicates(list(key)).join(current.select(*key), list(key), "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def audit_counts(**tables: DataFrame) -> DataFrame:
    """Number of rows of each table."""
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def last_job(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """The row inserted last."""
    return jobs.orderBy(F.col(seq).desc()).limit(1)
