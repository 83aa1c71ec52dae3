"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

from .errors import ValidationError

# Runtime settings only, so they can be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Compiled methods beyond this size are never optimized by the JVM. Above it, wide
    # projections are better off as separate, smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Of a key written twice in one JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Batches for Python are bounded in bytes too, as lines and texts can be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on. Sizes (shuffle partitions) stay the cluster's."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Pinned, so that reading a file twice splits it twice in the same way.
        parallelism = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(parallelism))
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path for a table written between two stages.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``, or the one
    set as checkpoint folder of the session. Only a session that runs in one process, as
    tests do, falls back to a local folder; elsewhere that would scatter the table.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValidationError("Name a folder that all executors share in spark.checkpoint.dir.")
        root = _local_scratch()
    # One folder for each application, which can be removed whole once it has ended.
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


@cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
