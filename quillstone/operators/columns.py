"""Column statistics over the long form (id, y, j, v): grouped aggregates, no column is a task of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import average_rank_by_counts, quantiles


def describe(long: DataFrame) -> DataFrame:
    """Per column j: distinct values, moments (corrected for the sample), quartiles, MAD and Tukey outliers."""
    n, g1, g2 = F.count("v").cast("double"), F.skewness("v"), F.kurtosis("v")
    moments = long.groupBy("j").agg(
        F.countDistinct("v").alias("n_unique"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.var_samp("v").alias("var"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2).alias("skew"), F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3)).alias("kurtosis"), F.count("v").alias("n"),
    )
    quart = quantiles(long, [0.25, 0.5, 0.75], "j").select("j", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    quart = F.broadcast(quart)  # a row per column
    joined = long.select("j", "v").join(quart, "j")
    mad = quantiles(joined.select("j", F.abs(F.col("v") - F.col("median")).alias("v")), [0.5], "j").select("j", F.col("q")[0].alias("mad"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    outliers = joined.groupBy("j").agg(F.count_if((F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)).alias("outliers"))
    return moments.join(quart, "j").join(mad, "j").join(outliers, "j").withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("outlier_pct", F.round(F.col("outliers") * 100.0 / F.col("n"), 2))


def positive_scale(long: DataFrame, least: int = 5) -> DataFrame:
    """(j, scale): the median of the positive values; 1 with fewer than `least` of them."""
    med = quantiles(long.where("v > 0"), [0.5], "j").select("j", F.when((F.col("total") >= least) & (F.col("q")[0] > 1e-10), F.col("q")[0]).otherwise(1.0).alias("scale"))
    return long.select("j").distinct().join(med, "j", "left").select("j", F.coalesce("scale", F.lit(1.0)).alias("scale"))


def quantile_edges(long: DataFrame, bins: int) -> DataFrame:
    """(j, edges): interior quantiles of the positive values, without repeats, in order."""
    inner = [k / bins for k in range(1, bins)]
    edges = quantiles(long.where("v > 0"), inner, "j").select("j", F.array_sort(F.array_distinct("q")).alias("edges"))
    return long.select("j").distinct().join(edges, "j", "left").select("j", F.coalesce("edges", F.array().cast("array<double>")).alias("edges"))


def bin_of(v, edges):
    """0 for zero, else 1 + the number of edges up to the value: a value on an edge goes right."""
    return F.when(v == 0, 0).otherwise(1 + F.size(F.filter(edges, lambda e: e <= v)))


def correlations(long: DataFrame, spearman: bool = False) -> DataFrame:
    """(a, b, n, r) for all pairs of columns a < b; null where a column is constant.

    Each id's standard scores are one vector; a task sums up the products of its vectors as one matrix, and
    what is shuffled is such a matrix per task, never a product per row.
    """
    cells = long.select("id", "j", "v")
    if spearman:
        ranks = average_rank_by_counts(cells, "v", "j")
        cells = cells.join(ranks, ["j", "v"]).select("id", "j", F.col("rank").alias("v"))
    means = F.broadcast(cells.groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")))  # a row per column
    unit = cells.join(means, "j").select("id", "j", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(float("nan")).alias("z"))
    rows = unit.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("j", "z"))).alias("r")).select("r.j", "r.z")  # one vector

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            keys = batch["j"].map(tuple)
            for js, z in batch["z"].groupby(keys):
                z = np.stack(z.to_numpy())
                had = sums.setdefault(js, [0, 0.0])
                had[0], had[1] = had[0] + len(z), had[1] + z.T @ z
        for js, (n, s) in sums.items():
            a, b = np.triu_indices(len(js), 1)
            yield pd.DataFrame({"a": np.array(js)[a], "b": np.array(js)[b], "n": n, "s": s[a, b]})

    pairs = rows.mapInPandas(gram, "a int, b int, n long, s double").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return pairs.select("a", "b", "n", F.nanvl(F.col("s") / F.col("n"), F.lit(None).cast("double")).alias("r"))
