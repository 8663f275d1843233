"""Results under version and split, each with a header, published at once.

A run's outputs go into a folder of their own, ``run-<number>``; its header is written last. Readers take the newest run that has a header, so a run
that fails, or isn't finished, leaves the one before it in place; a finished one then drops what is older."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.sources.tables import safe_version

OUTPUTS = ("summary", "by_dimension", "per_doc", "failures")
HEADER = "category string, dataset_version string, split string, generated_at string, methodology string, rows map<string, bigint>"


class Published:
    """One (version, split) below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, version: str, split: str):
        self.spark, self.version, self.split = spark, version, split
        self.folder = f"{path.rstrip('/')}/{safe_version(version)}/{split}"
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, finished: bool = True) -> list[int]:
        if not self._fs.exists(self._at(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.folder))]
        found = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"run-(\d+)", n)))
        return [n for n in found if not finished or self._fs.exists(self._at(f"{self.folder}/run-{n}/header/_SUCCESS"))]

    def publish(self, outputs: dict[str, DataFrame], category: str, generated_at: str, methodology: str = "") -> int:
        """Write ``outputs`` (of ``OUTPUTS``) as compressed JSON lines, then the header with the rows of each; gives the run's number."""
        if unknown := sorted(set(outputs) - set(OUTPUTS)):
            raise ValueError(f"unknown outputs: {', '.join(unknown)}")
        number = max(self.runs(finished=False), default=0) + 1
        to = f"{self.folder}/run-{number}"
        for name, df in outputs.items():
            df.write.option("compression", "gzip").json(f"{to}/{name}")
        rows = {name: self.spark.read.text(f"{to}/{name}").count() for name in outputs}
        self.spark.createDataFrame([(category, self.version, self.split, generated_at, methodology, rows)], HEADER).coalesce(1).write.json(f"{to}/header")
        for old in self.runs(finished=False):
            if old < number:
                self._fs.delete(self._at(f"{self.folder}/run-{old}"), True)
        return number

    def _newest(self) -> str:
        if not (runs := self.runs()):
            raise FileNotFoundError(f"nothing is published in {self.folder}")
        return f"{self.folder}/run-{runs[-1]}"

    def header(self) -> DataFrame:
        return self.spark.read.schema(HEADER).json(f"{self._newest()}/header")

    def read(self, name: str, schema: str) -> DataFrame:
        """An output's rows, each with the header's version and split."""
        return self.spark.read.schema(schema).json(f"{self._newest()}/{name}").withColumns({"dataset_version": F.lit(self.version), "split": F.lit(self.split)})
