"""Streams with keyed state; the module of a stateful processor travels with it.

The process on the driver that starts a stateful processor needn't have the
session's modules on its path, so they are sent by value, not by name.

Calls of a processor, and its calls for state and timers, cost some milliseconds
however little they do. Where keys are many and have few rows each, the key of
the stream is therefore a bucket of keys (`bucket`): their state is one value,
with one timer for what is due next.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A bucket's state is read and written whole by each batch that has rows of it; a stream with very many keys may take more. A running stream keeps its number.
BUCKETS = 1024
#: So many changes of a bucket go out at a time.
AT_ONCE = 10_000


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key, nulls included."""
    return F.pmod(F.hash(key), F.lit(buckets))


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within the block keep their state in RocksDB, as stateful processors need; the session's own setting stays."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
