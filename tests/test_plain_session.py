"""Stateful streams in a session without a state store of its own and without the library on its workers' path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from sluice.plans.queries import QUERIES
key = "spark.sql.streaming.stateStore.providerClass"
conf = {"spark.master": "local[4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": sys.argv[2] + "/shared", "spark.sql.warehouse.dir": sys.argv[2] + "/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
before = spark.conf.get(key)
assert "RocksDB" not in before
for name in ("watermark_stream", "retry_sweep"):
    assert QUERIES[name](spark, sys.argv[3]).count()
assert spark.conf.get(key) == before
print("all ran")
"""


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")
def test_stateful_streams_need_neither_path_nor_state_store(tmp_path):
    plain = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED")}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO), str(tmp_path), str(DATA)], cwd=tmp_path, env=plain, capture_output=True, text=True, timeout=600)
    assert "all ran" in run.stdout, run.stderr[-3000:]
