"""Responses kept by content hash in buckets, so that reading the newest of each key and pairing it with files shuffles no response.

A generation of the store is a bucketed Parquet table (by tool and content hash) in a folder of its own, ``gen-<number>-<buckets>``. Records are
appended to the newest one; ``compact`` writes the next generation with the newest record of each key and only then drops the
old one, so a failed compaction leaves the store as it was. Newest is the latest write; records written at once
follow their content. A store serves one writer at a time and any number of readers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.operators.scoring import newest
from gaugemill.sources.scratch import freeing
from gaugemill.sources.tables import RESPONSE

KEY = ("tool_id", "sha256")
#: Records of a bucket, as one task reads and sorts a bucket.
RECORDS = 200_000


def buckets_for(records: int) -> int:
    """Buckets of a store of about that many records."""
    return max(8, -(-records // RECORDS))


class ResponseStore:
    """``path``: a folder that all executors share. ``buckets`` counts for a new store; an old one keeps its number until it is compacted."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[tuple[int, int]]:
        """(number, buckets) of the finished generations, the newest last."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        found = [tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"gen-(\d+)-(\d+)", n))]
        return sorted(g for g in found if self._fs.exists(self._at(f"{self.folder(*g)}/_SUCCESS")))

    def folder(self, number: int, buckets: int) -> str:
        return f"{self.path}/gen-{number}-{buckets}"

    def _table(self, number: int, buckets: int) -> str:
        """The session's name for a generation; a table of the session only, all data is in its folder."""
        folder = self.folder(number, buckets)
        name = f"responses_{hashlib.sha1(folder.encode()).hexdigest()}"
        quoted = folder.replace("'", r"\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RESPONSE}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{quoted}' OPTIONS (compression 'zstd')")
        return name

    def _insert(self, rows: DataFrame, number: int, buckets: int) -> None:
        columns = [f.split()[0] for f in RESPONSE.split(", ")]
        dealt = rows.select(*columns).repartition(buckets, *KEY)  # one file a bucket
        with freeing(self.spark):
            dealt.write.mode("append").insertInto(self._table(number, buckets))
        self.spark.catalog.refreshTable(self._table(number, buckets))

    def append(self, responses: DataFrame) -> None:
        """Add records; slashes and colons of versions become underscores."""
        number, buckets = (self.generations() or [(1, self.buckets)])[-1]
        self._insert(responses.withColumn("tool_version", F.regexp_replace("tool_version", "[/:]", "_")), number, buckets)

    def records(self) -> DataFrame:
        """Every record, repeated ones too."""
        number, buckets = (self.generations() or [(1, self.buckets)])[-1]
        return self.spark.table(self._table(number, buckets))

    def read(self, versions: dict[str, str] | None = None, tools: Sequence[str] | None = None) -> DataFrame:
        """The newest record of each (tool, version, hash), without a shuffle; ``versions`` maps a tool to the one that counts."""
        rows = self.records()
        if tools is not None:
            rows = rows.filter(F.col("tool_id").isin(list(tools)))
        if versions is not None:
            safe = {t: re.sub("[/:]", "_", v) for t, v in versions.items()}
            rows = rows.filter(F.struct("tool_id", "tool_version").isin([F.struct(F.lit(t).alias("tool_id"), F.lit(v).alias("tool_version")) for t, v in safe.items()]))
        return newest(rows, (*KEY[:1], "tool_version", *KEY[1:]), "written_at")

    def compact(self) -> None:
        """Keep the newest record of each key only."""
        held = self.generations()
        if not held:
            return
        self._insert(self.read(), held[-1][0] + 1, self.buckets)
        for old in held:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(*old)}")
            self._fs.delete(self._at(self.folder(*old)), True)

    def pair(self, units: DataFrame, versions: dict[str, str]) -> DataFrame:
        """Units (tool_id, sha256, ...) with their newest record and ``status``: skipped, failed or answered. Only the units are shuffled."""
        found = self.read(versions).select(*KEY, "raw", "latency_ms", "cost_usd", "error", F.lit(True).alias("__there"))
        joined = units.join(found.hint("merge"), list(KEY), "left")
        return joined.withColumn("status", F.when(F.col("__there").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("answered")).drop("__there")

    def pending(self, units: DataFrame, versions: dict[str, str]) -> DataFrame:
        """Units without a record, or whose newest one has an error. Only the units are shuffled."""
        good = self.read(versions).filter("error is null").select(*KEY)
        return units.join(good.hint("merge"), list(KEY), "left_anti")
