"""Fitted models as versioned tables: every state of a model is a Parquet table, and a manifest row names them.

The manifest row is written last, so a version that was cut short does not exist.  Versions are
never changed; a new fit is a new version.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, version string, at string, spec string, features string, states string"


class ModelStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> DataFrame:
        """A row per model version: name, version, time of the fit, specification, names of features by state, states."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def save(self, name: str, states: dict[str, DataFrame], spec: dict | None = None, features: dict[str, list[str]] | None = None) -> str:
        """Writes the states and returns the version."""
        version = uuid.uuid4().hex
        for part, state in states.items():
            state.write.parquet(f"{self.root}/{name}/{version}/{part}")
        row = (name, version, datetime.now(UTC).isoformat(), json.dumps(spec or {}, sort_keys=True), json.dumps(features or {}), json.dumps(list(states)))
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def load(self, name: str, version: str | None = None) -> dict[str, DataFrame]:
        """The states of the version; without one the model must have exactly one."""
        rows = self.versions().where(F.col("name") == name)
        found = (rows if version is None else rows.where(F.col("version") == version)).limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{'more than one version' if found else 'no version'} of {name}" + (f" named {version}" if version else ""))
        return {part: self.spark.read.parquet(f"{self.root}/{name}/{found[0].version}/{part}") for part in json.loads(found[0].states)}

    def features(self, name: str, version: str) -> dict[str, list[str]]:
        found = self.versions().where((F.col("name") == name) & (F.col("version") == version)).limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{len(found)} versions {version} of {name}")
        return json.loads(found[0].features)
