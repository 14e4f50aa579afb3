"""Tables by key that take batches of changes: a batch writes its own rows, never the table anew."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from sluice.sources.store import cut, delete_paths, scratch


@dataclass(frozen=True)
class KeyedTable:
    """A folder of Parquet files: `rows`, one row a key, and `changes` by batch, both by bucket of the key's hash.

    Reading folds the changes over the rows. A row exists from the first batch
    that inserts its key; updates of keys that aren't there do nothing. Of each
    column the last value that isn't null counts; columns in `once` keep the
    value that the row was inserted with. Of several rows of a batch with one key
    the greatest value of each column counts. Rows without a key are left out.

    Batches are numbered from 1, in the order of their writing. A batch written
    again takes the place of itself, so a rerun changes nothing.
    """

    path: str
    key: str
    schema: StructType
    once: Sequence[str] = ()
    buckets: int = 64

    def __post_init__(self) -> None:
        if taken := {"key_seq", "born", "bucket", "batch"} & set(self.schema.names):
            raise ValueError(f"columns can't be named {sorted(taken)}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """One file for each bucket, more where a bucket is large."""
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).hint("rebalance", "bucket")

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add("key_seq", LongType()).add("born", LongType()).add("bucket", IntegerType())

    def _changes(self, spark: SparkSession, through: int | None = None) -> DataFrame:
        changes = spark.read.schema(self._stored().add("batch", LongType())).parquet(f"{self.path}/changes")
        return changes if through is None else changes.where(F.col("batch") <= through)

    def create(self, rows: DataFrame) -> None:
        """A new table with some `rows`."""
        first = rows.select(*(F.col(c).cast(self.schema[c].dataType) for c in self.schema.names), *(F.lit(0).cast("long").alias(c) for c in ("key_seq", "born")))
        self._bucketed(self._folded(first)).write.partitionBy("bucket").parquet(f"{self.path}/rows")
        self._bucketed(first.limit(0)).withColumn("batch", F.lit(0)).write.partitionBy("batch", "bucket").parquet(f"{self.path}/changes")

    def put(self, rows: DataFrame, batch: int, inserts: bool = True) -> None:
        """Write a batch: rows to insert or update, or (`inserts` false) updates only. Unknown columns are ignored, lists are joined by commas."""
        if batch < 1:
            raise ValueError("batches are numbered from 1")

        def value(c: str) -> Column:
            if c not in rows.columns:
                return F.lit(None)
            listed = rows.schema[c].dataType.typeName() == "array" and self.schema[c].dataType.typeName() == "string"
            return F.array_join(c, ", ") if listed else F.col(c)

        known = rows.select(*(value(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names), F.lit(batch).cast("long").alias("key_seq"), F.lit(batch if inserts else None).cast("long").alias("born"))
        # one row a key before rows are dealt to buckets, so that no key is too frequent
        greatest = known.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*(F.max(c).alias(c) for c in known.columns if c != self.key))
        self._bucketed(greatest.select(*known.columns)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/batch={batch}")

    def _folded(self, rows: DataFrame) -> DataFrame:
        """One row for each key that is inserted, with its latest `key_seq` and the batch that it was `born` in."""
        others = [c for c in self.schema.names if c != self.key]

        def of(c: str) -> Column:
            """The value of the last batch, or the one inserted first, and its batch."""
            on, said = F.col(c).isNotNull(), F.struct("key_seq", F.col(c).alias("value"))
            if c in self.once:
                return F.min_by(said, F.when(on & F.col("born").isNotNull(), F.struct("born", c)))
            return F.max_by(said, F.when(on, F.struct("key_seq", c)))

        found = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max("key_seq").alias("key_seq"), F.min("born").alias("born"), *(of(c).alias(c) for c in others))
        # what was said of a key before it was inserted doesn't count
        value = lambda c: F.when(F.col(f"{c}.key_seq") >= F.col("born"), F.col(f"{c}.value")).alias(c)
        return found.where("born is not null").select(*(F.col(c) if c == self.key else value(c) for c in self.schema.names), "key_seq", "born")

    def _all(self, spark: SparkSession, through: int | None = None) -> DataFrame:
        held = spark.read.schema(self._stored()).parquet(f"{self.path}/rows")
        return held.unionByName(self._changes(spark, through).drop("batch"))

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows as they are after all batches; one shuffle, whose map side already folds."""
        return self._folded(self._all(spark)).select(*self.schema.names)

    def touched(self, spark: SparkSession, through: int) -> list[int]:
        """Buckets that batches up to `through` have changed."""
        return sorted(r["bucket"] for r in self._changes(spark, through).select("bucket").distinct().collect())

    def compact(self, spark: SparkSession, through: int) -> None:
        """Fold batches up to `through` into the rows; only the buckets that they touched are written anew.

        The folded rows are written to the shared folder first. The batches are
        deleted last, and folding a batch twice changes nothing, so a compaction
        that was cut short can be repeated. No other may run at a time, and no
        reader while buckets are replaced. Later batches must have higher numbers.
        """
        with scratch(spark):
            some = self.touched(spark, through)
            if some:
                fold = cut(self._folded(self._all(spark, through).where(F.col("bucket").isin(some)).drop("bucket")), "keyed-rows")
                self._bucketed(fold).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
            done = [r["batch"] for r in self._changes(spark, through).select("batch").distinct().collect()]
            delete_paths(spark, [f"{self.path}/changes/batch={b}" for b in done])
