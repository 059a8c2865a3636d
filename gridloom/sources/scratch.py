"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A path that no other call uses, in the folder that all executors share; in local
    mode, where none is set, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
    return f"{base.rstrip('/')}/gridloom-files/{name}-{uuid.uuid4().hex}"
