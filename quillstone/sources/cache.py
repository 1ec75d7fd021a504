"""A content-addressed cache of tables: the key names what a table was computed from.

A table is there if its manifest row is, which is written last; a run that was cut
short leaves no manifest and is computed again under a new path.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, name string, path string, spec string"


def key_of(name: str, spec: dict) -> str:
    """SHA-256 of the canonical JSON; what does not change the table does not belong into the spec."""
    return hashlib.sha256(json.dumps([name, spec], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class TableCache:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def load(self, name: str, spec: dict) -> DataFrame:
        """The table; an error if it is missing or there twice."""
        found = self._manifest().where(F.col("key") == key_of(name, spec)).limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{len(found)} tables {name} for {spec}")
        return self.spark.read.parquet(found[0].path)

    def get(self, name: str, spec: dict, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
        """The table, computed and written if it is missing."""
        try:
            return self.load(name, spec)
        except LookupError:
            path = f"{self.root}/{name}/{key_of(name, spec)}-{uuid.uuid4().hex}"
            build().write.partitionBy(*partition_by).parquet(path)
            row = self.spark.createDataFrame([(key_of(name, spec), name, path, json.dumps(spec, sort_keys=True))], MANIFEST)
            row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
            return self.spark.read.parquet(path)
