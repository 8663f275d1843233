"""Outcomes and counts as responses arrive. Scoring is row by row, so it needs no state; counts keep a row a tool, or come from a response store that keeps the newest record of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugemill.sources.store import ResponseStore
from gaugemill.sources.tables import RESPONSE


def response_stream(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """New files of a response store, each once."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def latest_window(responses: DataFrame, late: str = "1 hour") -> DataFrame:
    """Repeated records of one answer within the watermark are dropped."""
    return responses.withWatermark("written_at", late).dropDuplicatesWithinWatermark(["tool_id", "tool_version", "sha256"])


def running_counts(responses: DataFrame) -> DataFrame:
    """Per tool answered and failed calls and their cost so far."""
    return responses.groupBy("tool_id").agg(F.count_if(F.col("error").isNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("cost_usd").alias("cost_usd"))


def keep_newest_counts(responses: DataFrame, store: ResponseStore, path: str, checkpoint: str) -> StreamingQuery:
    """Add a stream's records to ``store`` and keep at ``path`` the counts of the newest record of each key, a partition a tool.

    A batch only touches its own tools: their counts are taken again from the store's newest records. So a repeated response counts once, a newer
    one replaces the older, and a batch that is run again after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.append(batch)
        touched = [r["tool_id"] for r in batch.select("tool_id").distinct().collect()]  # a row a tool
        counts = running_counts(store.read(tools=touched))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tool_id").parquet(path)

    return responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts so far as a Parquet table at ``path``, written anew at each trigger."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
