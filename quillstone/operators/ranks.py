"""Ranks: average ranks inside partitions, and ranks of whole tables without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1 inside the partition; ties share the mean of their ranks."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def percentile_rank(value: str, *by: str) -> Column:
    return average_rank(value, *by) / F.count("*").over(Window.partitionBy(*by))


def global_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the 0-based place of each row in the order of a numeric key.

    The key's range is cut into equal steps; rows are numbered inside a step and steps get the
    counts before them, so no task sees all rows.  Only the number of steps is put in one order.
    """
    steps = 1024
    span = df.agg(F.min(key).cast("double").alias("lo"), F.max(key).cast("double").alias("hi"))
    stepped = df.join(F.broadcast(span)).withColumn("__step", F.coalesce(F.floor((F.col(key) - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / (steps - 1), F.lit(1e-300))), F.lit(-1)).cast("int")).drop("lo", "hi")
    counts = stepped.groupBy("__step").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__step", before.alias("__before")))  # at most steps + 1 rows
    local = F.row_number().over(Window.partitionBy("__step").orderBy(key)) - 1
    return stepped.withColumn("__local", local).join(offsets, "__step").withColumn(name, F.col("__before") + F.col("__local")).drop("__step", "__before", "__local")


def count_before(counts: DataFrame, value: str, *by: str, n: str = "n", steps: int = 64) -> DataFrame:
    """Adds `before`: the sum of n over the smaller values of the same group.

    counts has one row per (by, value).  The range of each group is cut into equal steps: sums
    run inside a step, and steps get the sums before them, so a column with very many
    distinct values is not one task.
    """
    spans = counts.groupBy(*by).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    spread = counts.join(spans, list(by)) if by else counts.join(F.broadcast(spans))  # without groups: one row
    width = F.greatest((F.col("__hi") - F.col("__lo")) / (steps - 1), F.lit(1e-300))
    spread = spread.withColumn("__step", F.floor((F.col(value) - F.col("__lo")) / width).cast("int")).drop("__lo", "__hi")
    sums = spread.groupBy(*by, "__step").agg(F.sum(n).alias("__n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__step", F.coalesce(F.sum("__n").over(earlier(Window.partitionBy(*by).orderBy("__step"))), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(n).over(earlier(Window.partitionBy(*by, "__step").orderBy(value))), F.lit(0))
    return spread.withColumn("__inside", inside).join(sums, [*by, "__step"]).withColumn("before", F.col("__base") + F.col("__inside")).drop("__step", "__inside", "__base")


def average_rank_by_counts(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, n, rank): average ranks of the distinct values of each group.

    Equal values are counted before anything is put in order, so a column with a
    mass of ties, such as zeros, costs one row.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return count_before(counts, value, *by).withColumn("rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)).drop("before")


def quantiles(df: DataFrame, probabilities: list[float], *by: str, value: str = "v", weight: str | None = None) -> DataFrame:
    """(by, total, q): exact quantiles with linear interpolation, as an array in the order asked; weight: rows that a row stands for."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    placed = count_before(counts, value, *by)
    placed = placed.join(totals, list(by)) if by else placed.join(F.broadcast(totals))  # without groups: one row
    last = F.col("before") + F.col("n")
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in probabilities]
    edges = [F.min(F.when(last > side(a), F.col(value))) for a in at for side in (F.floor, F.ceil)]
    got = placed.groupBy(*by, "total").agg(F.array(*edges).alias("e"))
    out = [F.col("e")[2 * i] + (F.col("e")[2 * i + 1] - F.col("e")[2 * i]) * (a - F.floor(a)) for i, a in enumerate(at)]
    return got.select(*by, "total", F.array(*out).alias("q"))


def feature_auc(long: DataFrame, *by: str, score: str = "v", label: str = "y", weight: str | None = None) -> DataFrame:
    """ROC-AUC with ties of `score` for each group of `by`; one class or a constant score gives 0.5.

    Works on counts per (group, distinct value, class): (sum of positive ranks - n1 (n1 + 1) / 2) / (n0 n1).
    """
    times = F.col(weight) if weight else F.lit(1)
    counts = long.groupBy(*by, score).agg(F.sum(times).alias("n"), F.sum(F.col(label) * times).cast("long").alias("pos"))
    ranked = count_before(counts, score, *by).withColumn("rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))
    sums = ranked.groupBy(*by).agg(F.sum("pos").alias("n1"), (F.sum("n") - F.sum("pos")).alias("n0"), F.sum(F.col("pos") * F.col("rank")).alias("s"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    auc = (F.col("s") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))
    return sums.select(*by, "n0", "n1", F.coalesce(auc, F.lit(0.5)).alias("auc"))
