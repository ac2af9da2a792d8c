"""The folder that all executors share, for what queries write and read again."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``.

    Where that is unset, a local one is set on one machine, as in tests; on a
    cluster, whose machines would not see it, that is an error.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="viewtrail-")).as_uri()
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
