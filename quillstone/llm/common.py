"""Helpers that all operators of this subpackage share.

Scratch tables: iterative operators cut their lineage by writing Parquet into the
folder that the cluster names in ``spark.checkpoint.dir`` and reading it back, so a
lost executor never loses state.  Only where that setting is absent and the master
is local (tests) a temporary folder is made and set.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of tables that may be released
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="scratch-")
    spark.sparkContext.setCheckpointDir(f"file://{root}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    Zstandard, since Snappy's writers hold direct buffers until the next garbage collection.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of what is done when the driver's collector finds it unreachable, which may be late.

    Python's comes first, since Java keeps what Python's handles hold; handles are let go beside the program, so both run twice.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has few enough rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would also change É, but is faster where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def unit_hash(*cols) -> Column:
    """A double in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under the operator's own names: extra columns never clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """Left join on key; right has a row per key.  A hot key's rows go to as many tasks as there are salts."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return left.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"], "left").drop("salt")
