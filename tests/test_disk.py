"""What a store's writes leave on disk."""

import time
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gaugemill.sources.scratch import freeing
from gaugemill.sources.store import ResponseStore

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_writes_of_a_store_leave_no_shuffle_files(spark, tmp_path):
    def shuffles():
        return {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*") if p.suffix in (".data", ".index")}

    k = F.col("id").cast("string")
    rows = spark.range(3000).select(
        F.lit("t").alias("tool_id"), F.lit("v").alias("tool_version"), k.alias("doc_id"), F.lit("clean").alias("variant"), F.sha2(k, 256).alias("sha256"), F.lit("{}").alias("raw"),
        F.lit(1.0).alias("latency_ms"), F.lit(1).cast("decimal(18,6)").alias("cost_usd"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(F.lit(1)).alias("written_at"),
    )
    store, before, cleanup = ResponseStore(spark, str(tmp_path / "store"), buckets=3), shuffles(), spark.conf.get(CLEANUP)
    store.append(rows)
    for _ in range(100):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == cleanup
    assert store.read().count() == 3000
    files = list(Path(tmp_path, "store").rglob("*.parquet"))
    assert len(files) == 3 and all(pq.ParquetFile(f).metadata.row_group(0).column(4).compression == "ZSTD" for f in files)


def test_freeing_puts_the_setting_back(spark):
    before = spark.conf.get(CLEANUP)
    try:
        with freeing(spark):
            assert spark.conf.get(CLEANUP) == "true"
            raise ValueError("a write failed")
    except ValueError:
        assert spark.conf.get(CLEANUP) == before
