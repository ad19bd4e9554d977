"""The folder that driver and executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a folder of our own where that is unset, on a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lucera-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
