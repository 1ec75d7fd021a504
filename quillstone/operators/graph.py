"""Connected components of a small or large edge table by rounds of joins."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of tables that may be released


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only local sessions may lack that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(f"file://{root}")
    return root.rstrip("/")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read again."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def release(*tables: DataFrame) -> None:
    """Deletes tables of cut_lineage() that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (u, v); root is the smallest node reached.

    A round takes the smallest root among the neighbours, then follows the root's own root, so
    the number of rounds grows with the logarithm of the paths for trees of hooks.
    """
    both = cut_lineage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut_lineage(hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
