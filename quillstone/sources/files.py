"""CSV and JSON sources and sinks with the checks on schemas, ids and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

ID, TARGET = "row_id", "target"


def csv_schema(features: list[str], labelled: bool) -> StructType:
    return StructType([StructField(ID, StringType()), *[StructField(f, DoubleType()) for f in features], *([StructField(TARGET, IntegerType())] if labelled else [])])


def read_vectors(spark: SparkSession, path: str, features: list[str], labelled: bool = True) -> DataFrame:
    """(id, x, y) from a CSV with a header; a header in another order is an error."""
    schema = csv_schema(features, labelled)
    head = spark.read.option("header", True).csv(path).columns
    if head != schema.names:
        raise ValueError(f"the header of {path} is not {ID}, the features in order{', target' if labelled else ''}")
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    y = F.col(TARGET) if labelled else F.lit(None).cast("int")
    return rows.select(F.col(ID).alias("id"), F.array(*[F.col(f"`{f}`") for f in features]).alias("x"), y.alias("y"))


def locate(spark: SparkSession, candidates: list[str], tables: list[str]) -> str:
    """The first folder that holds all tables; an error that names what each of them lacks, before any job runs."""
    lacks = {}
    for root in candidates:
        missing = []
        for t in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{t}.parquet")
            if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                missing.append(t)
        if not missing:
            return root
        lacks[root] = missing
    raise FileNotFoundError("; ".join(f"{r} lacks {', '.join(m)}" for r, m in lacks.items()) or "no folder is given")


def quality_report(vec: DataFrame) -> DataFrame:
    """One row: counts of rows, ids, nulls, NaN, infinite, negative and odd labels; two aggregates, no collection."""
    bad = lambda test: F.sum(F.size(F.filter("x", test)).cast("long"))
    ids = vec.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_ids"))
    facts = vec.agg(
        F.count("*").alias("n_rows"), bad(lambda v: v.isNull()).alias("nulls"), bad(F.isnan).alias("nans"), bad(lambda v: F.abs(v) == float("inf")).alias("infinite"), bad(lambda v: v < 0).alias("negative"),
        F.count_if(~F.col("y").isin(0, 1)).alias("odd_labels"), F.min(F.size("x")).cast("long").alias("width_min"), F.max(F.size("x")).cast("long").alias("width_max"),
    )
    return facts.join(ids)  # one row each


def submission(sample: DataFrame, scores: DataFrame) -> DataFrame:
    """sample(id, pos) with its score: every id once on both sides, finite scores in [0, 1]; an error otherwise."""
    once = lambda df, what: df.withColumn("__n", F.count("*").over(Window.partitionBy("id"))).withColumn("id", F.when(F.col("__n") == 1, F.col("id")).otherwise(F.raise_error(F.lit(f"an id is there twice in {what}")))).drop("__n")
    joined = once(sample, "the sample").join(once(scores, "the scores"), "id", "left")
    good = F.col("score").isNotNull() & F.col("score").between(0, 1) & ~F.isnan("score")
    return joined.select("id", "pos", F.when(good, F.col("score")).otherwise(F.raise_error(F.lit("a score is missing or outside [0, 1]"))).alias("score"))


def write_submission(rows: DataFrame, path: str) -> None:
    """An ordered CSV; parts are ranges of the order, so that no task holds all rows."""
    rows.repartitionByRange("pos").sortWithinPartitions("pos").select(F.col("id").alias(ID), F.col("score").alias(TARGET)).write.option("header", True).mode("overwrite").csv(path)


def flatten_run_log(log: DataFrame) -> DataFrame:
    """One row per entry of `results` of JSON run logs (column json)."""
    schema = "started string, results array<struct<model:string,cv:double,val:double,seconds:double>>"
    parsed = log.select(F.from_json("json", schema).alias("r"))
    return parsed.select("r.started", F.explode("r.results").alias("e")).select("started", "e.*").orderBy(F.desc("cv"), "model")
