"""Let Python workers import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: The setting for the bytes of a batch that goes to a worker, and what it is unless the session has its own: a batch is held on both sides, and the next one beside it.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Bytes of freed memory that a worker keeps, and Arrow's memory under the same rule; else an idle worker keeps about the most that it ever held, beside stages that have no Python too.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> SparkSession:
    """Add the package's parent folder to the PYTHONPATH of workers started later (on a cluster, ship it with --py-files), and bound what batches and freed memory take there."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark
