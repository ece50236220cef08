"""Where jobs keep tables between their steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the one that the cluster names in ``spark.checkpoint.dir``; a temporary one only if the session is local."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "local").startswith("local") or "cluster" in conf.get("spark.master", ""):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/job-{uuid.uuid4().hex}"
