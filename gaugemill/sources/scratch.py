"""A new folder under the cluster's shared checkpoint folder, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """The folder comes from ``spark.checkpoint.dir``. A local session without one, as in tests, gets a temporary one; a cluster without one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/gaugemill-{uuid.uuid4().hex}/{name}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written here drops its shuffle files at its end; else they stay until the driver collects its garbage, those of one write beside the next one's."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
