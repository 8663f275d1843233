"""Scratch space and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.sources.scratch import scratch as scratch  # one helper for the whole library

#: Characters of text that a task holds split into pieces at a time.
SLICE_CHARS = 1 << 21


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sized(df: DataFrame, limit: int, entries: Column | None = None) -> DataFrame:
    """``df`` for a join: broadcast if its counted rows, or the sum of their ``entries``, are at most ``limit``, else merged."""
    count = df.count() if entries is None else df.agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0]
    return F.broadcast(df) if count <= limit else df.hint("merge")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The strings of a column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as no bytes."""
    binary = pa.binary() if pa.types.is_string(column.type) else pa.large_binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def slices(items: list, limit: int = SLICE_CHARS) -> Iterator[range]:
    """Ranges of ``items`` of about ``limit`` characters each, so that a task never holds a whole batch in pieces."""
    at, size = 0, 0
    for i, item in enumerate(items):
        size += len(item) + 64
        if size >= limit:
            yield range(at, i + 1)
            at, size = i + 1, 0
    if at < len(items):
        yield range(at, len(items))


def portions(frame: pa.RecordBatch, column: int = 0, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """``frame`` in ranges of rows whose texts, in ``column``, have about ``limit`` bytes each: a task never holds a whole batch as strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(frame.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < frame.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield frame.slice(at, stop - at)
        at = stop


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
