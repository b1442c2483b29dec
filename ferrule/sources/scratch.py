"""Folders for tables that a query writes on its way: under the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; in one of this machine only if the session names none and runs locally."""
    found = spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set(KEY, found)
    return f"{found.rstrip('/')}/ferrule-{name}-{uuid.uuid4().hex}"
