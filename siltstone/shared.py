"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own under spark.checkpoint.dir; a temporary folder only where none is set and everything runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return f"{root.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
